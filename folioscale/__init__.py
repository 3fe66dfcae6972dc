"""folioscale: Spark-native processing of bibliographic and manuscript data."""

__version__ = "0.1.0"

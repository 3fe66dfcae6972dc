"""Operations of a training-data pipeline. Nothing else in folioscale imports this subpackage."""

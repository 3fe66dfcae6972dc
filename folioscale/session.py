"""Spark sessions for tests, benchmarks and scripts.

On a cluster the session is made by the caller; nothing in the library
overrides its settings.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Where local sessions keep what jobs cut from their lineage; on a cluster it is a shared folder that the caller names.
CHECKPOINTS = os.path.join(tempfile.gettempdir(), "folioscale-checkpoints")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoints: str = CHECKPOINTS) -> SparkSession:
    """A local session with the settings the library is developed against."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscale")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", checkpoints)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

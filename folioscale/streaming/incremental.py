"""Incremental runs: files taken once, identifiers seen once, logs upserted.

Streams are plain Structured Streaming with a file source and the trigger
availableNow, so a run takes what has come since the last and stops. State is
kept in the checkpoint and in written tables; a run that fails is repeated
without doubling.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stream of the files of a folder, each taken once."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(folder)


def run_once(stream: DataFrame, write, checkpoint: str) -> None:
    """Take what is there and stop; write(batch, batch_id) must be safe to repeat."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def seen_once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose keys were not seen within the delay. The time may be without zone; it is read as UTC."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(keys)


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def swap_in(rows: DataFrame, path: str) -> None:
    """Replace a Parquet table by rows that may be read from it: staged beside it, then renamed."""
    spark = rows.sparkSession
    staged = f"{path}.{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{path}.old"
    files.delete(hadoop(old), True)
    if files.exists(hadoop(path)):
        files.rename(hadoop(path), hadoop(old))
    files.rename(hadoop(staged), hadoop(path))
    files.delete(hadoop(old), True)


def append_unseen(batch: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table does not have; repeating it adds nothing."""
    batch = batch.dropDuplicates(keys)
    if _exists(batch.sparkSession, path):
        batch = batch.join(batch.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    batch.write.mode("append").parquet(path)


def upsert(batch: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Rows of the batch replace those of the same keys, the last of a key by order; others stay."""
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")
    spark = batch.sparkSession
    if _exists(spark, path):
        kept = spark.read.parquet(path).join(last.select(*keys), keys, "left_anti")
        last = kept.unionByName(last, allowMissingColumns=True)
    swap_in(last, path)


def first_seen(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(day, new_pairs): the batch equivalent of dropping keys seen before, counted by day."""
    first = events.groupBy(*keys).agg(F.min(time).alias("t"))
    return first.groupBy(F.to_date("t").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("new_pairs"))


def upserted(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, value, writes): the table that upserting all events leaves."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("writes"))

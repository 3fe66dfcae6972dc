"""Helpers for jobs that must survive skew, growth and lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a side may have to be broadcast, and rows that are looked at to tell.
BROADCAST_BYTES, BROADCAST_ROWS = 16_000_000, 200_000
#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are.
HOT_SHARE = 2_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the session's shared checkpoint folder and read it from there.

    The folder is the one the cluster names in spark.checkpoint.dir; only where
    none is set (tests, one machine) a temporary folder is taken.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioscale-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's checkpoint folder, for files that a job writes and reads again."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcast if its rows, measured as JSON, have at most so many bytes; else leave the choice to the planner.

    df is read for it, so it should be cheap to compute or already cut from its lineage.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    row = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if row.n <= BROADCAST_ROWS and row.bytes <= most_bytes else df


def attach_group(rows: DataFrame, groups: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of rows with one row per key, safe when a few keys hold most rows.

    groups has `keys`, the number of its rows in `count`, and further columns.
    Keys with more than 1/HOT_SHARE of all rows are joined by a broadcast of at
    most HOT_SHARE groups, the others by a shuffle that has no hot key left.
    groups is written to the checkpoint folder, since it is used three times.
    """
    groups = cut_lineage(groups)
    total = groups.agg(F.sum(count)).first()[0]
    if total is None:
        return rows.join(groups, keys)
    hot = groups.where(F.col(count) > total / HOT_SHARE)
    if not hot.take(1):
        return rows.join(groups, keys)
    cold = groups.where(F.col(count) <= total / HOT_SHARE)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


def salt(column: Column | str, buckets: int, seed: int = 0) -> Column:
    """A bucket number from 0 that depends on the value only, so reruns agree."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column) if isinstance(column, str) else column), F.lit(buckets)).cast("int")


def numbered(rows: DataFrame, keys: list[str], order: str, into: str, buckets: int = 64) -> DataFrame:
    """Number the rows of each key from 0, without one task holding a whole key.

    Rows are spread over buckets by the hash of `order`; a bucket's numbers
    start where the counts of the key's earlier buckets end. Rows equal in
    `order` may take each other's number.
    """
    from pyspark.sql import Window

    spread = rows.withColumn("_bucket", salt(order, buckets))
    counts = spread.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        spread.withColumn("_local", F.row_number().over(local) - 1)
        .join(starts, [*keys, "_bucket"])
        .withColumn(into, (F.col("_start") + F.col("_local")).cast("long"))
        .drop("_bucket", "_local", "_start")
    )


def map_groups(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """function(frame) for each group of a key, many small groups a task.

    Rows are sorted within partitions and cut into groups as they stream by,
    which spares what applyInPandas spends on every group. A group must fit
    into memory, as there. function takes and returns a pandas DataFrame.
    """
    import pandas as pd

    def run(batches):
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            open_end = rows[key] == rows[key].iloc[-1]
            done, rest = rows[~open_end], rows[open_end]
            if len(done):
                yield pd.concat([function(group) for _, group in done.groupby(key, sort=False)], ignore_index=True)
        if rest is not None:
            yield function(rest)

    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.where(F.col(key).isNotNull()).repartition(partitions, key).sortWithinPartitions(key).mapInPandas(run, schema)

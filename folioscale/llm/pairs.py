"""All pairs within groups, where a result has to list them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.runtime import HOT_SHARE

#: Rows of a hot group that one task pairs with the whole group.
BLOCK = 2_000


def pairs_within(rows: DataFrame, key: str, ident: str, *others: str) -> DataFrame:
    """(a, b) of all ids a < b that share a key, with the other columns as <name>_a, <name>_b.

    Groups with more than 1/HOT_SHARE of the rows (so at most HOT_SHARE) are
    cut into blocks of about BLOCK rows on the left, which meet the whole group
    on the right, so no task holds all pairs of a hot group. Null keys pair nothing.
    rows should be cut from their lineage, since they are read several times.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    hot = F.broadcast(sizes.where(F.col("n") > max(BLOCK, total / HOT_SHARE)).select(key, F.ceil(F.col("n") / BLOCK).cast("int").alias("_blocks")))
    split = rows.join(hot, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    left = split.select(key, F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int").alias("_block"), F.col(ident).alias("a"), *[F.col(name).alias(f"{name}_a") for name in others])
    right = split.select(key, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col(ident).alias("b"), *[F.col(name).alias(f"{name}_b") for name in others])
    return left.join(right, [key, "_block"]).where("a < b").drop(key, "_block")

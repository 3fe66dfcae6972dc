"""Ordered rows: headings carried forward, trees of sections, runs and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, value: Column, by: str, order: str, into: str) -> DataFrame:
    """The last value seen so far in each group; null before the first."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(window))


def blocks(rows: DataFrame, starts: Column, by: str, order: str, into: str = "block") -> DataFrame:
    """Rows numbered by the starts before and at them; 0 before the first."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(window))


def link_tree(nodes: DataFrame, by: str, order: str, level: str, depth: int = 3) -> DataFrame:
    """Parent (nearest earlier node of a smaller level) and neighbours of the same level under one parent."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = nodes
    for k in range(1, depth):
        out = out.withColumn(f"_l{k}", F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(upto))
    parent = F.greatest(*[F.when(F.col(level) > k, F.col(f"_l{k}")) for k in range(1, depth)], F.lit(None).cast("long"))
    out = out.withColumn("parent", parent)
    siblings = Window.partitionBy(by, "parent", level).orderBy(order)
    out = out.withColumns({"preceding": F.lag(order).over(siblings), "following": F.lead(order).over(siblings)})
    return out.drop(*[f"_l{k}" for k in range(1, depth)])


def ancestors(tree: DataFrame, ident: str, parent: str, depth: int) -> DataFrame:
    """(id, ancestor, distance): parents, their parents and so on, as many joins as levels."""
    edges = tree.select(F.col(ident).alias("id"), F.col(parent).alias("ancestor")).where("ancestor is not null")
    out = step = edges.withColumn("distance", F.lit(1))
    for distance in range(2, depth + 1):
        up = edges.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
        step = step.join(up, "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(distance).alias("distance"))
        out = out.unionByName(step)
    return out


def runs(rows: DataFrame, same: Column, by: str, order: str, least: int) -> DataFrame:
    """(by, run_start, length): runs of at least `least` rows; `same` tells whether a row goes on from the one before."""
    window = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "_run").agg(F.min(order).alias("run_start"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("_run")


def previous(column: str, by: str, order: str) -> Column:
    return F.lag(column).over(Window.partitionBy(by).orderBy(order))


def until_misses(rows: DataFrame, hit: str, by: str, order: str, most: int = 3) -> DataFrame:
    """Hits before the first `most` misses in a row."""
    window = Window.partitionBy(by).orderBy(order)
    last = window.rowsBetween(-(most - 1), 0)
    misses = rows.withColumn("_miss", F.sum((~F.col(hit)).cast("int")).over(last))
    stopped = misses.withColumn("_stop", F.max((F.col("_miss") >= most).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return stopped.where((F.col("_stop") == 0) & F.col(hit)).drop("_miss", "_stop")


def gaps(rows: DataFrame, number: str, by: str) -> DataFrame:
    """(by, after, before): numbers between which others are missing."""
    distinct = rows.select(by, F.col(number).alias("before")).where("before is not null").distinct()
    window = Window.partitionBy(by).orderBy("before")
    return distinct.withColumn("after", F.lag("before").over(window)).where("before - after > 1").select(by, "after", "before")

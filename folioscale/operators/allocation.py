"""Quotas, work splitting and the sequential packing of small work items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.functions import text as X

#: How many records the pool wants per tag group, and the least quota of a direction.
POOL_TARGETS = {"BG": 50, "LR": 150, "METHOD": 60, "GAP": 75, "DISC": 65}
MIN_QUOTA = 20


def tag_groups(directions: DataFrame) -> DataFrame:
    """(id, tag_group): the groups each direction serves, once."""
    return directions.select("id", F.explode("tags").alias("tag")).where("tag is not null").select("id", X.quota_group("tag").alias("tag_group")).distinct()


def pool_targets(directions: DataFrame) -> DataFrame:
    """(tag_group, target): GAP and DISC count only if a tag names a question."""
    spark = directions.sparkSession
    table = spark.createDataFrame(list(POOL_TARGETS.items()), "tag_group string, target int")
    tags = directions.select(F.explode("tags").alias("tag"))
    named = tags.where("tag like 'GAP-RQ%' or tag like 'DISC-RQ%'").select(X.quota_group("tag").alias("tag_group")).distinct()
    return table.where(~F.col("tag_group").isin("GAP", "DISC")).unionByName(table.where(F.col("tag_group").isin("GAP", "DISC")).join(named, "tag_group", "left_semi"))


def apportion(directions: DataFrame, budget: int | Column, least: int = MIN_QUOTA) -> DataFrame:
    """(id, raw_demand, quota): the budget by demand, with a least quota.

    Demand is the sum, over the groups a direction serves, of the group's
    target by the number of directions that serve it. Quotas under the least
    are raised and the others scaled to what is left (a quota that comes to
    the least by itself counts as raised); if nothing is left, all get the
    same. What rounding leaves goes to the first largest. Without any demand
    the result is empty.
    """
    groups = tag_groups(directions)
    share = pool_targets(directions).join(groups.groupBy("tag_group").agg(F.count(F.lit(1)).alias("n")), "tag_group").select("tag_group", (F.col("target") / F.col("n")).alias("share"))
    demand = groups.join(F.broadcast(share), "tag_group").groupBy("id").agg(F.sum("share").alias("d"))
    rows = directions.select("id").join(demand, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("raw_demand"))
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    # one row a direction: a few thousand, so the windows over all of them are small by nature
    whole = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({"total": F.sum("raw_demand").over(whole), "n": F.count(F.lit(1)).over(whole), "budget": budget}).where("total > 0")
    rows = rows.withColumn("first", F.bround(F.col("budget") * F.col("raw_demand") / F.col("total")).cast("long"))
    rows = rows.withColumns({"raised": F.greatest(F.col("first"), F.lit(least)), "short": F.max((F.col("first") < least).cast("int")).over(whole) == 1})
    fixed = F.col("raised") == least
    rows = rows.withColumns({"left": F.col("budget") - F.sum(F.when(fixed, F.col("raised")).otherwise(0)).over(whole), "free": F.sum(F.when(fixed, 0.0).otherwise(F.col("raw_demand"))).over(whole), "fixed": fixed})
    quota = (
        F.when(~F.col("short"), F.col("raised"))
        .when(F.col("left") <= 0, F.greatest(F.lit(1), F.floor(F.col("budget") / F.col("n"))))
        .when((F.col("free") > 0) & ~F.col("fixed"), F.bround(F.col("left") * F.col("raw_demand") / F.nullif(F.col("free"), F.lit(0.0))))
        .otherwise(F.col("raised"))
        .cast("long")
    )
    rows = rows.withColumn("quota", quota)
    rows = rows.withColumns({"over": F.col("budget") - F.sum("quota").over(whole), "place": F.row_number().over(whole.orderBy(F.col("quota").desc(), "id"))})
    return rows.select("id", "raw_demand", (F.col("quota") + F.when(F.col("place") == 1, F.col("over")).otherwise(0)).cast("long").alias("quota"))


def tier_split(quotas: DataFrame, quota: str = "quota") -> DataFrame:
    """core and important rounded up, backup the rest, none below 0."""
    q = F.col(quota).cast("double")
    core, important = F.ceil(q * F.lit(0.25)).cast("long"), F.ceil(q * F.lit(0.40)).cast("long")
    rest = F.col(quota) - core - important
    return quotas.withColumns({"core": core, "important": F.when(rest < 0, F.col(quota) - core).otherwise(important), "backup": F.greatest(rest, F.lit(0))})


def split_work(items: DataFrame, count: str, limit: str, quota: str | None = None) -> DataFrame:
    """Each item in ceil(count / limit) nearly equal ranges, from 1, both ends included; counts of 0 are dropped."""
    n = F.ceil(F.col(count) / F.col(limit)).cast("long")
    cut = items.where((F.col(count) > 0) & (F.col(limit) > 0)).withColumns({"_n": n}).withColumn("_size", F.ceil(F.col(count) / F.col("_n")).cast("long"))
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    out = {"range_start": (F.col("part") - 1) * F.col("_size") + 1, "range_end": F.least(F.col("part") * F.col("_size"), F.col(count).cast("long")), "parts": F.col("_n")}
    if quota:
        out["quota_share"] = F.ceil(F.col(quota) / F.col("_n")).cast("long")
    return cut.withColumns(out).withColumn("part_count", F.col("range_end") - F.col("range_start") + 1).drop("_n", "_size")


def batch_sequence(parts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Running number of a key's parts over all its source files."""
    return parts.withColumn("batch_seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def first_fit(items: DataFrame, group: str, order: str, count: str, limit: str) -> DataFrame:
    """(group, order, count, bin): items of at most half the limit packed first-fit by falling count, others alone.

    Sequential by definition, one small group at a time; large pools are what
    a packing by size classes is for.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        limits = int(rows[limit].iloc[0])
        rows = rows.sort_values(order, ignore_index=True)
        large = rows[rows[count] > limits // 2]
        small = rows[rows[count] <= limits // 2].sort_values(count, ascending=False, kind="stable")
        rooms: list[int] = []
        bins = []
        for size in small[count]:
            at = next((i for i, room in enumerate(rooms) if size <= room), len(rooms))
            if at == len(rooms):
                rooms.append(limits)
            rooms[at] -= int(size)
            bins.append(at)
        out = pd.concat([large.assign(bin=range(1, len(large) + 1)), small.assign(bin=[len(large) + 1 + at for at in bins])])
        return out[[group, order, count, "bin"]]

    fields = {field.name: field.dataType.simpleString() for field in items.schema}
    wanted = items.where((F.col(count) > 0) & (F.col(limit) > 0) & F.col(group).isNotNull())
    return wanted.groupBy(group).applyInPandas(pack, f"{group} {fields[group]}, {order} {fields[order]}, {count} {fields[count]}, bin long")


def word_budget(sections: DataFrame, total: str, lines: str, heavy: str, by: str) -> DataFrame:
    """Words by share of lines, a tenth more if heavy with formulas, to the nearest 50."""
    share = F.col(total) * F.col(lines) / F.sum(lines).over(Window.partitionBy(by))
    return sections.withColumn("words", (F.bround(share * F.when(F.col(heavy), 1.1).otherwise(1.0) / 50) * 50).cast("long"))


def last_weighted(rows: DataFrame, value: str, by: str, order: str, weight: float = 1.2) -> DataFrame:
    """The last row of each group weighted."""
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc())) == 1
    return rows.withColumn("weighted", F.col(value) * F.when(last, weight).otherwise(1.0))

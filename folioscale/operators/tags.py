"""Counts and matrices of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.functions import text as X

#: How many records each tag group should have.
ADEQUACY = {"BG": 50, "LR": 150, "GAP": 75, "METHOD": 60, "DISC": 65}
#: The closed vocabulary of tags.
VOCABULARY = ("BG", "LR", "COMP", "METHOD-基础", "METHOD-先例", *(f"GAP-RQ{i}" for i in range(1, 6)), *(f"DISC-RQ{i}" for i in range(1, 6)))


def long_tags(rows: DataFrame, tags: str, *keep: str) -> DataFrame:
    """One row a record and tag; records without tags have none."""
    return rows.select(*keep, F.explode(tags).alias("tag")).where("tag is not null")


def counts(rows: DataFrame, tags: str, tier: str, direction: str) -> DataFrame:
    """Counts by (tag, tier) and by (direction, tag) in one pass; `kind` tells which."""
    sets = long_tags(rows, tags, tier, direction).groupingSets([["tag", tier], [direction, "tag"]], "tag", tier, direction)
    return sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n")).select(F.when(F.col("g") == 1, "tag_tier").otherwise("direction_tag").alias("kind"), "tag", tier, direction, "n")


def groups(rows: DataFrame, tags: str) -> DataFrame:
    """Records per tag group; a record with two tags of a group counts twice."""
    return long_tags(rows, tags).groupBy(X.stats_group("tag").alias("tag_group")).agg(F.count(F.lit(1)).alias("actual"))


def adequacy(rows: DataFrame, tags: str) -> DataFrame:
    """Each wanted group with its target, count, rate in per cent and sign; groups without records have 0."""
    targets = rows.sparkSession.createDataFrame(list(ADEQUACY.items()), "tag_group string, target int")
    joined = targets.join(groups(rows, tags), "tag_group", "left").select("tag_group", "target", F.coalesce("actual", F.lit(0)).alias("actual"))
    rate = F.col("actual") / F.col("target") * 100
    return joined.withColumn("rate", rate).withColumn("status", X.rate_status(F.round("rate", 1)))


def matrix(rows: DataFrame, tags: str, by: str, values: list[str], column: Column) -> DataFrame:
    """by x values, 0 where there is none."""
    exploded = rows.select(by, F.explode(tags).alias("tag")).where("tag is not null").select(by, column.alias("_v"))
    return exploded.groupBy(by).pivot("_v", values).count().na.fill(0, values)


def valid(tags: Column | str) -> Column:
    """The tags of the vocabulary, BG variants as BG, in order."""
    parts = F.transform(F.col(tags) if isinstance(tags, str) else tags, lambda t: F.when(X.strip(t).rlike(r"^BG\s*\("), "BG").otherwise(X.strip(t)))
    return F.filter(parts, lambda t: t.isin(*VOCABULARY))


def search(rows: DataFrame, tags: str, wanted: list[str], every: bool = False) -> DataFrame:
    """Rows of which any (or every) wanted tag is part of a tag, whatever the case; hits count every pair."""

    def hits(word: str) -> Column:
        return F.size(F.filter(tags, lambda tag: F.contains(F.lower(tag), F.lit(word.lower()))))

    pairs = [hits(word) for word in wanted]
    found = [pair > 0 for pair in pairs]
    test = found[0]
    for other in found[1:]:
        test = (test & other) if every else (test | other)
    total = pairs[0]
    for pair in pairs[1:]:
        total = total + pair
    return rows.where(F.col(tags).isNotNull() & test).withColumn("hits", total.cast("long"))

"""Constraints as tables of violations: (code, key), empty if all hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.functions import text as X

KEY_FORM = r"^[a-z][a-z0-9]*\d{4}[a-z][a-z]?$"


def violations(*parts: tuple[str, DataFrame, Column]) -> DataFrame:
    """The rows of each part, with its code and the key named."""
    return reduce(DataFrame.unionByName, [rows.select(F.lit(code).alias("code"), key.cast("string").alias("key")) for code, rows, key in parts])


def verdict(found: DataFrame) -> DataFrame:
    """One row: PASS or FAIL, and how many violations."""
    return found.agg(F.count(F.lit(1)).alias("violations")).withColumn("verdict", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def pool(entries: DataFrame) -> DataFrame:
    """Citation keys of the wanted form and unique, tags given, authors real."""
    ident, key = F.col("entry_id"), F.col("citation_key")
    twice = entries.where(key.isNotNull()).groupBy("citation_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violations(
        ("KEY_FORMAT", entries.where(~F.coalesce(key, F.lit("")).rlike(KEY_FORM)), ident),
        ("KEY_DUPLICATE", twice, key),
        ("NO_TAGS", entries.where(F.coalesce(F.trim("标签"), F.lit("")) == ""), ident),
        ("PLACEHOLDER_AUTHOR", entries.where(F.coalesce(F.lower(F.trim("作者")), F.lit("")).isin(*X.PLACEHOLDER_AUTHORS)), ident),
    )


def quotas(split: DataFrame, directions: DataFrame, budget: int | Column, least: int = 20) -> DataFrame:
    """The sum is the budget (a number, or an aggregate of the quotas' rows), none is under the least, tiers add up, every tag group is covered, every direction has tags."""
    wanted = budget if isinstance(budget, Column) else F.lit(budget)
    total = split.agg(F.sum("quota").alias("s"), wanted.alias("wanted")).where("s <> wanted")
    spark = split.sparkSession
    wanted = spark.createDataFrame([(tag,) for tag in ("BG", "LR", "METHOD", "GAP", "DISC")], "tag_group string")
    covered = directions.select(F.explode("tags").alias("tag")).where("tag is not null").select(X.quota_group("tag").alias("tag_group")).distinct()
    bare = directions.where(F.size(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull())) == 0)
    return violations(
        ("SUM_MISMATCH", total, F.col("s")),
        ("MIN_VIOLATION", split.where(F.col("quota") < least), F.col("id")),
        ("TIER_MISMATCH", split.where("core + important + backup <> quota"), F.col("id")),
        ("TAG_UNCOVERED", wanted.join(covered, "tag_group", "left_anti"), F.col("tag_group")),
        ("NO_TAGS", bare, F.col("id")),
    )


def dispatch(items: DataFrame, parts: DataFrame, ident: str, count: str, limit: str) -> DataFrame:
    """No part over the limit, counts kept, every item with a count and a limit served."""
    due = items.where((F.col(count) > 0) & (F.col(limit) > 0)).select(ident, F.col(count).cast("long").alias("due"))
    given = parts.groupBy(ident).agg(F.sum("part_count").alias("given"))
    both = due.join(given, ident, "full")
    return violations(
        ("OVER_LIMIT", parts.where(F.col("part_count") > F.col(limit)), F.col(ident)),
        ("COUNT_MISMATCH", both.where("due is not null and given is not null and due <> given"), F.col(ident)),
        ("MISSING_COVERAGE", both.where("given is null"), F.col(ident)),
    )


def braces(text: Column) -> Column:
    """Whether braces balance and never close before they open."""
    depth = F.aggregate(F.split(F.regexp_replace(text, r"[^{}]", ""), ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda s, c: F.struct((s["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("d"), F.least(s["low"], s["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("low")))
    return (depth["d"] == 0) & (depth["low"] == 0)

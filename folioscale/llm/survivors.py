"""The best representative of each group of duplicate records.

Fields are unpivoted to long rows (key, field, normalised value); each row
votes for its values with source trust times recency decay; the votes of
equal values are summed, the winner of a field is taken by max_by (of equal
votes the smaller value), and the winners are pivoted back to one record a
group. Multi-valued fields are unpivoted likewise, each member being voted
for; they keep all their members, the best supported first. The row that
stands for the group is one more field, its candidates being compared by a
stated order in place of votes. All sums and maxima combine before they are
shuffled, and the first sum is shuffled by key, field and value, so a group
may hold any share of the rows.

Defined results: rows with a null key take no part; null, blank and
placeholder values (—, -, N/A, 无) do not vote; a field without votes is
null, a multi-valued one an empty list; a row votes once for a member however
often it names it; a null timestamp decays as if it were of 1970; votes are
compared by their logarithms to nine digits, so neither their age nor the
order of summing decides.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.functions.tiers import tier_name, tier_rank

#: What stands for a missing value.
PLACEHOLDERS = ("", "—", "-", "N/A", "无")
#: Days in which a vote loses half its weight.
HALF_LIFE_DAYS = 365.0
#: How much a source is trusted; others count 1.
TRUST = {"wos": 1.0, "cnki": 0.9}


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$", "")


def filled(column: Column) -> Column:
    """Whether a value is there: not null, blank or a placeholder."""
    text = _trim(column.cast("string"))
    return column.isNotNull() & ~text.isin(*PLACEHOLDERS) & ~F.upper(text).isin("N/A")


def vote(trust: Column, when: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """Trust times recency decay. The reference date cancels out, since all votes decay by the same law."""
    days = F.unix_micros(F.coalesce(when, F.lit("1970-01-01").cast("timestamp_ntz")).cast("timestamp")) / F.lit(86_400e6)
    return trust * F.pow(F.lit(2.0), (days - F.lit(19_700.0)) / F.lit(half_life_days))


_ROW = "__row"


def elect(df: DataFrame, key: str, fields: dict[str, Column], weight: Column, row_id: str, row_order: Column, lists: dict[str, Column] | None = None) -> DataFrame:
    """One record a key: each field's value of most votes, the leading row and the number of rows.

    fields maps an output column to the expression voted on (its values are
    taken as text), lists one to an array of whole numbers. row_order is a
    struct; the row with the largest stands for the group. Output: key,
    <fields>, <lists>, row_id, n_rows.
    """
    lists = lists or {}
    named = {f"__f_{name}": expression.cast("string") for name, expression in fields.items()} | {f"__l_{name}": F.array_distinct(expression).cast("array<string>") for name, expression in lists.items()}
    base = df.where(F.col(key).isNotNull()).select(F.col(key), weight.alias("__w"), F.col(row_id).cast("string").alias(_ROW), row_order.alias("__order"), *[expression.alias(name) for name, expression in named.items()])

    def pair(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), text.alias("value"))

    single = F.array(pair(_ROW, F.col(_ROW)), *[pair(name, F.when(filled(F.col(f"__f_{name}")), _trim(F.col(f"__f_{name}")))) for name in fields])
    several = [F.transform(F.coalesce(f"__l_{name}", F.array().cast("array<string>")), partial(pair, name)) for name in lists]
    long = base.select(key, "__w", "__order", F.explode(F.concat(single, *several)).alias("p")).where("p.value is not null")
    is_row = F.col("p.field") == _ROW
    votes = long.groupBy(key, "p.field", "p.value").agg(F.round(F.log2(F.sum("__w")), 9).alias("votes"), F.max(F.when(is_row, F.col("__order"))).alias("__order"), F.count_if(is_row).alias("n"))
    own = lambda name, column: F.when(F.col("field") == name, column)
    best_first = F.struct(-F.col("votes"), F.col("value"))
    member = F.struct((-F.col("votes")).alias("v"), F.col("value").cast("long").alias("m"))
    found = votes.groupBy(key).agg(
        *[F.min_by(own(name, F.col("value")), own(name, best_first)).alias(name) for name in fields],
        *[F.array_sort(F.collect_list(own(name, member)))["m"].alias(name) for name in lists],
        F.max_by(own(_ROW, F.col("value")), own(_ROW, F.col("__order"))).cast("long").alias(row_id), F.sum("n").alias("n_rows"),
    )
    return found.select(key, *fields, *lists, row_id, "n_rows")


def paper_order() -> Column:
    """Best tier, smallest direction (null last), most fields filled, latest merge, smallest rec_id."""
    count = sum((filled(F.col(name)).cast("int") for name in ("title", "first_author", "year", "journal", "reason")), F.lit(0))
    return F.struct(
        (-tier_rank("tier")).alias("tier"),
        F.coalesce(-F.col("direction").cast("long"), F.lit(-(2**40))).alias("direction"),
        count.alias("filled"),
        F.col("merged_at").alias("at"),
        (-F.col("rec_id")).alias("id"),
    )


def _trusted() -> Column:
    return vote(F.coalesce(F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])[F.lower(F.col("source_type"))], F.lit(1.0)), F.col("merged_at"))


def _directions() -> Column:
    """All directions a row names."""
    every = F.concat(F.array(F.col("direction").cast("long")), F.coalesce(F.col("directions").cast("array<long>"), F.array().cast("array<long>")))
    return F.filter(every, lambda d: d.isNotNull())


def merged_papers(df: DataFrame) -> DataFrame:
    """The surviving record of each dedup_key of merged_papers, with its merged list of directions."""
    fields = {"tier": F.when(filled(F.col("tier")), tier_name("tier")), **{name: F.col(name) for name in ("direction", "title", "first_author", "year", "journal", "reason", "source_type")}}
    return elect(df, "dedup_key", fields, _trusted(), "rec_id", paper_order(), {"directions": _directions()})


def merged_directions(df: DataFrame) -> DataFrame:
    """(dedup_key, directions, rec_id, n_rows): as merged_papers, only the multi-valued field being voted on."""
    return elect(df, "dedup_key", {}, _trusted(), "rec_id", paper_order(), {"directions": _directions()})

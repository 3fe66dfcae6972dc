"""Merging of screened records: duplicates, tier caps, unique lists, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.functions.tiers import TIERS, tier_rank

#: Shares of a quota that the tiers may fill (floored; doubles, as 0.35 times a quota must be).
TIER_CAPS = (0.25, 0.40, 0.35)


def screened(papers: DataFrame, ord_col: str = "paper_id", length: int = 80) -> DataFrame:
    """The records with their dedup key, tier rank, origin and input order; those without a direction are left out."""
    return papers.where(F.col("direction").isNotNull()).select(
        F.col(ord_col).alias("ord"), F.col("direction").cast("long").alias("direction"), "title", "first_author", "year", "journal",
        tier_rank("tier").alias("rank"), (X.source_type("source_type", "title", "first_author", "journal") == "cnki").alias("is_cnki"),
        X.dedup_key("first_author", "year", "title", length).alias("key"),
    )


def dedup_within(rows: DataFrame) -> DataFrame:
    """The best tier of each key in a direction; the first of equal tiers; `first_ord` is where the key first stood.

    An aggregation, not a window: copies are combined before the shuffle, however many a key has.
    """
    rest = [name for name in rows.columns if name not in ("direction", "key")]
    best = F.min_by(F.struct(*rest), F.struct("rank", "ord"))
    return rows.groupBy("direction", "key").agg(best.alias("b"), F.min("ord").alias("first_ord")).select("direction", "key", "b.*", "first_ord")


def tier_cap(quota: Column, rank: Column) -> Column:
    """The cap of a tier: the floored share of the quota, at least 1."""
    cap = F.lit(None)
    for level, share in enumerate(TIER_CAPS):
        cap = F.when(rank == level, F.greatest(F.lit(1), F.floor(quota.cast("double") * F.lit(share)).cast("int"))).otherwise(cap)
    return cap


def truncate(rows: DataFrame, quota: str, by: list[str], most: int) -> DataFrame:
    """Rows within their tier's cap, and within the quota overall, in tier then input order.

    most bounds every quota. As a literal it lets each partition drop what can
    not be among the first before a group is gathered.
    """
    ranked = rows.withColumn("in_tier", F.row_number().over(Window.partitionBy(*by, "rank").orderBy("first_ord"))).where(F.col("in_tier") <= most)
    capped = ranked.where(F.col("in_tier") <= tier_cap(F.col(quota), F.col("rank")))
    return capped.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "first_ord"))).where(F.col("place") <= F.col(quota)).drop("in_tier")


def merge(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Deduplicated and truncated rows of each direction. quotas has direction, quota and, for two tracks, cnki_quota.

    With a positive cnki_quota the two origins are truncated apart, else together.
    """
    dual_tracks = "cnki_quota" in quotas.columns
    largest = quotas.agg(F.max(F.greatest("quota", "cnki_quota") if dual_tracks else F.col("quota"))).first()[0] or 0
    joined = dedup_within(rows).join(quotas, "direction")
    if not dual_tracks:
        return truncate(joined, "quota", ["direction"], max(1, largest))
    dual = F.coalesce(F.col("cnki_quota"), F.lit(0)) > 0
    tracked = joined.withColumns({"track": F.when(dual & F.col("is_cnki"), "cnki").when(dual, "wos").otherwise("all"), "own": F.when(dual & F.col("is_cnki"), F.col("cnki_quota")).otherwise(F.col("quota"))})
    return truncate(tracked, "own", ["direction", "track"], max(1, largest))


def summary(rows: DataFrame) -> DataFrame:
    """Records of each tier per direction, with a last row (direction null) for all."""
    counts = [F.count_if(F.col("rank") == level).alias(name) for level, name in enumerate(TIERS)]
    return rows.rollup("direction").agg(*counts, F.count(F.lit(1)).alias("total"))


def cross_duplicates(rows: DataFrame) -> DataFrame:
    """One row: keys, and how many extra directions they appear in."""
    return rows.groupBy("key").agg(F.countDistinct("direction").alias("dirs")).agg(F.count(F.lit(1)).alias("unique_keys"), F.coalesce(F.sum(F.col("dirs") - 1), F.lit(0)).alias("duplicates"))


def flatten_unique(rows: DataFrame) -> DataFrame:
    """One row a key: best tier, then smallest direction, with all its directions."""
    best = F.min_by(F.struct("ord", "direction", "rank", "title"), F.struct("rank", "direction", "ord"))
    flat = rows.groupBy("key").agg(best.alias("b"), F.array_sort(F.collect_set("direction")).alias("directions"))
    return flat.select("key", F.col("b.ord").alias("ord"), F.col("b.direction").alias("primary_direction"), F.col("b.rank").alias("rank"), F.col("b.title").alias("title"), "directions")


def merge_attributes(rows: DataFrame) -> DataFrame:
    """One row a key: best tier, first source key, and directions, tags and reasons in first-seen order.

    rows: key, ord, rank, direction, reason, tags (array), source_key. Values
    are reduced to their first places before a key is gathered, so a key may
    have any number of rows.
    """
    heads = rows.groupBy("key").agg(F.min("rank").alias("rank"), F.min("ord").alias("first_ord"), F.min_by("source_key", F.when(F.col("source_key") != "", F.col("ord"))).alias("source_key"))
    one = lambda name: rows.select("key", F.lit(name).alias("field"), F.col(name).cast("string").alias("value"), F.struct("ord", F.lit(0).alias("at")).alias("place"))
    tags = rows.select("key", F.lit("tags").alias("field"), "ord", F.posexplode("tags").alias("at", "value")).select("key", "field", "value", F.struct("ord", "at").alias("place"))
    firsts = one("direction").unionByName(one("reason")).unionByName(tags).where("value is not null").groupBy("key", "field", "value").agg(F.min("place").alias("place"))
    lists = firsts.groupBy("key").agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == name, F.struct("place", "value")))).alias(name) for name in ("direction", "reason", "tags")])
    values = lambda name: F.coalesce(F.col(f"{name}.value"), F.array().cast("array<string>"))
    return heads.join(lists, "key", "left").select("key", "rank", "first_ord", values("direction").cast("array<long>").alias("directions"), values("reason").alias("reasons"), values("tags").alias("tags"), "source_key")


def resolve_keys(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Citation keys made unique: the first in order stays bare, the next get b, c, ... (letters end at 26)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", n).withColumn("resolved_key", F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(key, F.chr(F.col("_n") + 96)))).drop("_n")


def zone_screen(rows: DataFrame, journals: DataFrame, most: int = 2) -> DataFrame:
    """Rows with the zone of their journal: ISSNs in record order, then the name; unmatched rows are kept, last.

    rows: ord, issns (array), journal. journals: ord, issn, eissn, name, zone; the last row of a key wins.
    """
    issns = journals.select("ord", F.explode(F.array(F.upper(X.strip("issn")), F.upper(X.strip("eissn")))).alias("key"), "zone").where("key is not null and key not in ('', '-')")
    by_issn = issns.groupBy("key").agg(F.max_by("zone", "ord").alias("zone"))
    by_name = journals.where("name is not null").groupBy(F.upper(X.strip("name")).alias("name_key")).agg(F.max_by("zone", "ord").alias("name_zone"))
    probe = rows.select("ord", F.posexplode(X.issn_list("issns")).alias("at", "key")).join(by_issn, "key").groupBy("ord").agg(F.min_by("zone", "at").alias("issn_zone"))
    found = rows.join(probe, "ord", "left").join(by_name, F.upper(X.strip("journal")) == F.col("name_key"), "left").withColumn("zone", F.coalesce("issn_zone", "name_zone"))
    return found.where(F.col("zone").isNull() | (F.col("zone") <= most)).withColumn("unmatched", F.col("zone").isNull()).drop("issn_zone", "name_key", "name_zone")


def kept_by_verdict(rows: DataFrame, verdict: str, failed: str, title: str, abstract: str) -> DataFrame:
    """Rows judged relevant, rows whose judgement failed, and rows with nothing to judge; in this order by `order_class`."""
    nothing = (F.coalesce(X.strip(title), F.lit("")) == "") & (F.coalesce(X.strip(abstract), F.lit("")) == "")
    kind = F.when(nothing | F.coalesce(F.col(verdict), F.lit(False)), 0).when(F.coalesce(F.col(failed), F.lit(False)), 1)
    return rows.withColumn("order_class", kind).where("order_class is not null")

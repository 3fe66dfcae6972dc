"""Queries of the screening path: keys, duplicates, quotas, truncation, unique lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.functions.tiers import tier_rank
from folioscale.operators import allocation, matching, screening
from folioscale.plans import sqltext as S
from folioscale.plans.registry import Registry
from folioscale.runtime import read_table

registry = Registry()
query = registry.query

#: Budget of a search plan per direction.
BUDGET_PER_DIRECTION = 30


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "papers")


@query(lambda: f"with {S.nfkd_table()} select paper_id, {S.normalize('title')} as form from papers, nf where title is not null")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).where("title is not null").select("paper_id", X.normalize("title").alias("form"))


@query(lambda: f"with {S.nfkd_table()} select paper_id, {S.dedup_key('first_author', 'year', 'title', 80)} as key80, {S.dedup_key('first_author', 'year', 'title', 40)} as key40, lower(coalesce(first_author, '')) || '_' || coalesce(year::varchar, '') || '_' || lower(left(coalesce(title, ''), 40)) as report_key from papers, nf")
def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).select("paper_id", X.dedup_key("first_author", "year", "title", 80).alias("key80"), X.dedup_key("first_author", "year", "title", 40).alias("key40"), X.report_key("first_author", "year", "title").alias("report_key"))


@query(lambda: f"select paper_id, case when {S.is_cnki('title', 'first_author', 'journal')} then 'cnki' else 'wos' end as source_type, {S.RANK} as rank from papers")
def source_and_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).select("paper_id", X.source_type("source_type", "title", "first_author", "journal").alias("source_type"), tier_rank("tier").alias("rank"))


@query(lambda: f"with {S.citation_keys('papers', 'first_author', 'year', 'title', 'paper_id')} select id as paper_id, citation_key from keyed")
def citation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).select("paper_id", X.citation_key("first_author", "year", "title").alias("citation_key"))


@query(
    lambda: f"""with {S.citation_keys('source_papers', 'first_author', 'year', 'title', 'source_id')}, numbered as (select id, citation_key, row_number() over (partition by citation_key order by id) as n from keyed)
    select id as source_id, citation_key, citation_key || case when n = 1 then '' else chr((96 + n)::int) end as resolved_key from numbered"""
)
def key_conflict_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "source_papers").select("source_id", X.citation_key("first_author", "year", "title").alias("citation_key"))
    return screening.resolve_keys(rows, "citation_key", "source_id")


_DEDUP = "best as (select *, row_number() over (partition by direction, key order by rank, ord) n, min(ord) over (partition by direction, key) first_ord from rows), uniq as (select * from best where n = 1)"


@query(lambda: f"with {S.screened()}, {_DEDUP} select direction, key, ord, rank, first_ord from uniq")
def dedup_within_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.dedup_within(screening.screened(_papers(spark, sf_dir))).select("direction", "key", "ord", "rank", "first_ord")


_QUOTA_SQL = """
grp as (select distinct id, {group} as tag_group from (select id, unnest(tags) as tag from directions) where tag is not null),
named as (select distinct {group} as tag_group from (select unnest(tags) as tag from directions) where tag like 'GAP-RQ%' or tag like 'DISC-RQ%'),
tgt as (select * from (values ('BG', 50), ('LR', 150), ('METHOD', 60), ('GAP', 75), ('DISC', 65)) t(tag_group, target) where tag_group not in ('GAP', 'DISC') or tag_group in (select tag_group from named)),
share as (select tag_group, target / count(*)::double as share from tgt join grp using (tag_group) group by tag_group, target),
demand as (select d.id, coalesce(sum(share), 0)::double as raw_demand from directions d left join grp on grp.id = d.id left join share using (tag_group) group by d.id),
r1 as (select *, sum(raw_demand) over () as total, count(*) over () as n, {budget} as budget from demand),
r2 as (select *, round_even(budget * raw_demand / total, 0)::bigint as first from r1 where total > 0),
r3 as (select *, greatest(first, 20) as raised, max((first < 20)::int) over () = 1 as short from r2),
r4 as (select *, budget - sum(case when raised = 20 then raised else 0 end) over () as left_over, sum(case when raised = 20 then 0.0::double else raw_demand end) over () as free from r3),
r5 as (select *, (case when not short then raised when left_over <= 0 then greatest(1, budget // n) when free > 0 and raised <> 20 then round_even(left_over * raw_demand / free, 0) else raised end)::bigint as q from r4),
r6 as (select *, budget - sum(q) over () as over_, row_number() over (order by q desc, id) as place from r5),
quotas as (select id, raw_demand, (q + case when place = 1 then over_ else 0 end)::bigint as quota from r6)"""


def quota_sql(budget: str) -> str:
    return _QUOTA_SQL.format(group=S.quota_group("tag"), budget=budget)


def _budget(per_direction: int = BUDGET_PER_DIRECTION) -> Column:
    """So many records for each direction, counted where the budget is apportioned."""
    return F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) * per_direction


@query(lambda: f"with {quota_sql(f'(select count(*) * {BUDGET_PER_DIRECTION} from directions)')} select id, round(raw_demand, 6) as raw_demand, quota from quotas")
def quota_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    directions = read_table(spark, sf_dir, "directions")
    return allocation.apportion(directions, _budget()).select("id", F.round("raw_demand", 6).alias("raw_demand"), "quota")


@query(lambda: f"with {quota_sql('(select count(*) * 5 from directions)')} select id, quota from quotas")
def quota_below_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget the least quotas exceed: the same for all, the residue to the first."""
    directions = read_table(spark, sf_dir, "directions")
    return allocation.apportion(directions, _budget(5)).select("id", "quota")


@query(
    lambda: f"""with {quota_sql(f'(select count(*) * {BUDGET_PER_DIRECTION} from directions)')}, t as (select id, quota, ceil(quota * 0.25::double)::bigint as core, ceil(quota * 0.40::double)::bigint as important from quotas)
    select id, quota, core, case when quota - core - important < 0 then quota - core else important end as important, greatest(quota - core - important, 0) as backup from t"""
)
def quota_tier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    directions = read_table(spark, sf_dir, "directions")
    return allocation.tier_split(allocation.apportion(directions, _budget()).select("id", "quota"))


def _quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    directions = read_table(spark, sf_dir, "directions")
    return allocation.apportion(directions, _budget()).select(F.col("id").cast("long").alias("direction"), "quota")


def _truncated(quota: str, by: str) -> str:
    caps = "greatest(1, floor({q}::double * case rank when 0 then 0.25::double when 1 then 0.40::double else 0.35::double end)::int)".format(q=quota)
    return f"""capped as (select *, row_number() over (partition by {by}, rank order by first_ord) as in_tier from joined),
    ranked as (select *, row_number() over (partition by {by} order by rank, first_ord) as place from capped where in_tier <= {caps}),
    kept as (select * from ranked where place <= {quota})"""


@query(
    lambda: f"with {S.screened()}, {_DEDUP}, {quota_sql(f'(select count(*) * {BUDGET_PER_DIRECTION} from directions)')}, joined as (select uniq.*, quota from uniq join quotas on quotas.id = uniq.direction), {_truncated('quota', 'direction')} select direction, ord, rank, place from kept"
)
def tier_capped_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.merge(screening.screened(_papers(spark, sf_dir)), _quotas(spark, sf_dir)).select("direction", "ord", "rank", "place")


@query(
    lambda: f"""with {S.screened()}, {_DEDUP}, {quota_sql(f'(select count(*) * {BUDGET_PER_DIRECTION} from directions)')},
    joined as (select uniq.*, case when direction % 2 = 0 and is_cnki then 8 else quota end as own, case when direction % 2 <> 0 then 'all' when is_cnki then 'cnki' else 'wos' end as track from uniq join quotas on quotas.id = uniq.direction),
    {_truncated('own', 'direction, track')} select direction, track, ord, rank, place from kept"""
)
def dual_track_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of even number have a quota of 8 for Chinese records, the others one track."""
    quotas = _quotas(spark, sf_dir).withColumn("cnki_quota", F.when(F.col("direction") % 2 == 0, 8).otherwise(0).cast("long"))
    return screening.merge(screening.screened(_papers(spark, sf_dir)), quotas).select("direction", "track", "ord", "rank", "place")


@query(
    lambda: f"with {S.screened()}, {_DEDUP}, {quota_sql(f'(select count(*) * {BUDGET_PER_DIRECTION} from directions)')}, joined as (select uniq.*, quota from uniq join quotas on quotas.id = uniq.direction), {_truncated('quota', 'direction')} select direction, count(*) filter (rank = 0) as core, count(*) filter (rank = 1) as important, count(*) filter (rank = 2) as backup, count(*) as total from kept group by rollup (direction)"
)
def direction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: merged records of each direction by tier, and all together."""
    return screening.summary(screening.merge(screening.screened(_papers(spark, sf_dir)), _quotas(spark, sf_dir)))


@query(lambda: f"with {S.screened()}, c as (select key, count(distinct direction) as dirs from rows group by key) select count(*) as unique_keys, coalesce(sum(dirs - 1), 0)::bigint as duplicates from c")
def cross_direction_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.cross_duplicates(screening.screened(_papers(spark, sf_dir)))


@query(
    lambda: f"with {S.screened()}, b as (select *, row_number() over (partition by key order by rank, direction, ord) n from rows), d as (select key, list_sort(list(distinct direction)) as directions from rows group by key) select b.key, ord, direction as primary_direction, rank, title, directions from b join d using (key) where n = 1"
)
def flatten_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.flatten_unique(screening.screened(_papers(spark, sf_dir)))


@query(
    """with rows as (select s.dedup_key as key, s.source_id as ord, case lower(trim(tier)) when 'core' then 0 when '核心' then 0 when 'important' then 1 when '重要' then 1 else 2 end as rank, journal as reason, tags, source_cite_key from source_papers s where dedup_key is not null),
    t as (select key, list(tag order by pos) as tags from (select key, tag, min((ord, i)) as pos from (select key, ord, unnest(tags) as tag, generate_subscripts(tags, 1) as i from rows) group by key, tag) group by key),
    r as (select key, list(reason order by pos) as reasons from (select key, reason, min(ord) as pos from rows where reason is not null group by key, reason) group by key)
    select b.key, min(rank) as rank, min(ord) as first_ord, coalesce(any_value(r.reasons), []) as reasons, coalesce(any_value(t.tags), []) as tags, arg_min(source_cite_key, ord) filter (source_cite_key is not null and source_cite_key <> '') as source_key
    from rows b left join t using (key) left join r using (key) group by b.key"""
)
def merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "source_papers").where("dedup_key is not null")
    rows = rows.select(F.col("dedup_key").alias("key"), F.col("source_id").alias("ord"), tier_rank("tier").alias("rank"), F.lit(0).cast("long").alias("direction"), F.col("journal").alias("reason"), "tags", F.col("source_cite_key").alias("source_key"))
    return screening.merge_attributes(rows).drop("directions")


@query("""
    with j as (select upper(trim(issn)) as issn, upper(trim(name)) as name, tier as zone, row_number() over (order by id) as ord from journals),
    i as (select issn, arg_max(zone, ord) as z from j where issn is not null and issn not in ('', '-') group by issn),
    n as (select name, arg_max(zone, ord) as z from j where name is not null group by name),
    p as (select paper_id as ord, case when paper_id % 3 = 0 then '1234-5678' end as i1, (select issn from journals where journals.name = papers.journal limit 1) as i2, journal from papers),
    f as (select p.ord, coalesce((select z from i where i.issn = upper(trim(p.i1))), (select z from i where i.issn = upper(trim(p.i2))), (select z from n where n.name = upper(trim(p.journal)))) as zone from p)
    select ord, zone, zone is null as unmatched from f where zone is null or zone <= 2""")
def zone_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third record has an unknown ISSN first; the second is that of its journal."""
    journals = read_table(spark, sf_dir, "journals")
    known = F.broadcast(journals.groupBy(F.col("name").alias("journal")).agg(F.min("issn").alias("own")))
    rows = _papers(spark, sf_dir).join(known, "journal", "left").select(F.col("paper_id").alias("ord"), "journal", F.array(F.when(F.col("paper_id") % 3 == 0, "1234-5678"), "own").alias("issns"))
    rows = rows.withColumn("issns", F.array_compact("issns"))
    table = journals.select(F.row_number().over(_all("id")).alias("ord"), "issn", F.lit(None).cast("string").alias("eissn"), "name", F.col("tier").alias("zone"))
    return screening.zone_screen(rows, table).select("ord", "zone", "unmatched")


def _all(order: str):
    """A window over a dimension of a few dozen rows."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


@query("""
    with v as (select paper_id, relevance >= 500 as verdict, relevance is null as failed, title, reason from papers),
    c as (select paper_id, case when (coalesce(trim(title), '') = '' and coalesce(trim(reason), '') = '') or coalesce(verdict, false) then 0 when failed then 1 end as order_class from v)
    select * from c where order_class is not null""")
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _papers(spark, sf_dir).select("paper_id", (F.col("relevance") >= 500).alias("verdict"), F.col("relevance").isNull().alias("failed"), "title", "reason")
    return screening.kept_by_verdict(rows, "verdict", "failed", "title", "reason").select("paper_id", "order_class")


def _source_side() -> str:
    return f"src as (select source_id as ord, {S.lead_author('first_author')} as surname, coalesce(left(year::varchar, 4), '') as year, coalesce({S.normalize('title')}, '') as form from source_papers, nf)"


@query(
    lambda: f"""with {S.nfkd_table()}, {_source_side()}, pap as (select paper_id as ord, {S.lead_author('first_author')} as surname, coalesce(left(year::varchar, 4), '') as year, coalesce({S.normalize('title')}, '') as form from papers, nf),
    sz as (select surname, year, count(*) as candidates, min(ord) as only_ from pap group by all),
    pr as (select s.ord, p.ord as entry_ord, least(length(s.form), length(p.form), 40) as l from src s join sz using (surname, year) join pap p using (surname, year) where candidates > 1 and left(s.form, least(length(s.form), length(p.form), 40)::int) = left(p.form, least(length(s.form), length(p.form), 40)::int) and least(length(s.form), length(p.form)) > 0),
    best as (select ord, entry_ord from pr qualify row_number() over (partition by ord order by l desc, entry_ord) = 1)
    select s.ord, case when coalesce(candidates, 0) <= 1 then only_ else entry_ord end as entry_ord, coalesce(candidates, 0) as candidates from src s left join sz using (surname, year) left join best using (ord)"""
)
def blocked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography records matched to screened records."""
    papers = read_table(spark, sf_dir, "source_papers").select(F.col("source_id").alias("ord"), F.col("first_author").alias("author"), "year", "title")
    entries = _papers(spark, sf_dir).select(F.col("paper_id").alias("ord"), F.col("first_author").alias("author"), "year", "title")
    return matching.blocked_match(papers, entries)


def _forms() -> str:
    side = f"(select paper_id as ord, direction, {S.RANK} as rank, {S.lead_author('first_author')} as surname, coalesce(year::varchar, '') as y, coalesce({S.normalize('title')}, '') as form from papers, nf where direction is not null)"
    return f"{S.nfkd_table()}, ent as {side}, sel as (select * from ent where rank = 0)"


@query(
    lambda: f"""with {_forms()} select ord from ent where (form <> '' and (direction, form) in (select (direction, form) from sel))
    or (length(form) >= 30 and (direction, y, left(form, 60)) in (select (direction, y, left(form, 60)) from sel where length(form) >= 30)) or (surname <> '' and length(form) >= 20 and (direction, surname, y, left(form, 20)) in (select (direction, surname, y, left(form, 20)) from sel where length(form) >= 20))"""
)
def selected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a core record of their direction names."""
    entries = _papers(spark, sf_dir).where("direction is not null").select(F.col("paper_id").alias("ord"), F.col("first_author").alias("author"), "year", "title", "direction", tier_rank("tier").alias("rank"))
    return matching.selected_entries(entries, entries.where("rank = 0"), ["direction"])


@query(lambda: f"with {_forms()}, kept as (select form from ent where rank > 0) select ord from sel where form not in (select form from kept) and left(form, 60) not in (select left(form, 60) from kept)")
def unmatched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core records that no other record repeats."""
    rows = _papers(spark, sf_dir).where("direction is not null").select(F.col("paper_id").alias("ord"), "title", tier_rank("tier").alias("rank"))
    return matching.unmatched(rows.where("rank = 0"), rows.where("rank > 0")).select("ord")

"""Queries of reports: totals, coverage, changes, gates and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.functions.tiers import tier_rank
from folioscale.operators import audits, letters, reports, screening, tags
from folioscale.plans import sqltext as S
from folioscale.plans.registry import Registry
from folioscale.plans.texts import COMMENTS
from folioscale.runtime import read_table

registry = Registry()
query = registry.query


@query(f"with k as (select lower(coalesce(first_author, '')) || '_' || coalesce(year::varchar, '') || '_' || lower(left(coalesce(title, ''), 40)) as key, min({S.RANK}) as rank from papers group by 1), t as (select rank, count(*) as n from k group by rank) select rank, n, case rank when 0 then 50 when 1 then 80 else 40 end as target, case when n >= case rank when 0 then 50 when 1 then 80 else 40 end then '✅' else '⚠️' end as status from t")
def tier_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "papers").withColumn("rank", tier_rank("tier"))
    return reports.tier_adequacy(reports.tier_totals(rows, X.report_key("first_author", "year", "title")))


@query(f"with g as (select distinct id, {S.quota_group('tag')} as tag_group from (select id, unnest(tags) as tag from directions) where tag is not null), l as (select tag_group, list_sort(list(id)) as directions from g group by tag_group) select t as tag_group, coalesce(directions, []) as directions from (select unnest(['BG', 'LR', 'METHOD', 'GAP', 'DISC']) as t) left join l on l.tag_group = t")
def pool_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([(t,) for t in ("BG", "LR", "METHOD", "GAP", "DISC")], "tag_group string")
    return reports.coverage(read_table(spark, sf_dir, "directions"), targets)


@query(f"with t as (select unnest(tags) as tag from source_papers), g as (select {S.stats_group('tag')} as tag_group, count(*) as actual from t where tag is not null group by 1), r as (select v.tag_group, coalesce(actual, 0) / v.target::double * 100 as rate from (values ('BG', 50), ('LR', 150), ('GAP', 75), ('METHOD', 60), ('DISC', 65)) v(tag_group, target) left join g using (tag_group)) select * from r order by rate, tag_group limit 1")
def lowest_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.lowest_rate(tags.adequacy(read_table(spark, sf_dir, "source_papers"), "tags"))


@query("with c as (select distinct citation_key as k from pool_entries where citation_key is not null), p as (select distinct unnest(regexp_extract_all(text, '\\\\cite\\w*\\*?\\{([^}]*)\\}', 1)) as g from documents), d as (select distinct trim(unnest(string_split(g, ','))) as k from p) select count(*) as keys, count(d.k) as cited, count(d.k) / count(*)::double as rate from c left join d using (k)")
def back_citation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the pool that any document cites with any cite command."""
    groups = read_table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\\cite\w*\*?\{([^}]*)\}"), 1)).alias("g"))
    cited = groups.select(F.explode(F.split("g", ",")).alias("key")).withColumn("key", F.trim("key"))
    return reports.back_citation_rate(cited, read_table(spark, sf_dir, "pool_entries").select(F.col("citation_key").alias("key")), "key")


@query("""with b as (select source_type as section, unnest(regexp_extract_all(coalesce(title, ''), '\\S+')) as w, 1 as n from papers), a as (select source_type as section, unnest(regexp_extract_all(coalesce(title, ''), '\\S+')) as w, 1 as n from merged_papers),
    cb as (select section, w, count(*) as b from b group by all), ca as (select section, w, count(*) as a from a group by all), j as (select coalesce(cb.section, ca.section) as section, coalesce(a, 0) - coalesce(b, 0) as d from cb full join ca on cb.section = ca.section and cb.w = ca.w)
    select section, sum(greatest(d, 0))::bigint as added, sum(greatest(-d, 0))::bigint as deleted, sum(d)::bigint as net from j where section is not null group by section""")
def section_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of titles by source type, from screened to merged records."""
    part = lambda name: read_table(spark, sf_dir, name).select(F.col("source_type").alias("section"), F.col("title").alias("text"))
    return reports.section_changes(part("papers"), part("merged_papers")).where("section is not null")


@query("select count(*) filter (j.tier = 1) as zone_1, count(*) filter (j.tier = 2) as zone_2, count(*) filter (j.tier = 3) as zone_3, count(*) filter (j.tier = 4) as zone_4, count(*) filter (j.tier is null) as unmatched from papers left join (select upper(trim(name)) as k, arg_max(tier, id) as tier from journals where name is not null group by 1) j on j.k = upper(trim(papers.journal))")
def zone_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = read_table(spark, sf_dir, "journals").where("name is not null").groupBy(F.upper(F.trim("name")).alias("k")).agg(F.max_by("tier", "id").alias("zone"))
    return reports.zones(read_table(spark, sf_dir, "papers").join(F.broadcast(dimension), F.upper(F.trim("journal")) == F.col("k"), "left"))


@query(lambda: f"with {S.screened()} select count(*) as total, count(*) - count(distinct key) as duplicates, count(distinct key) as unique_keys, (select count(*) from (select row_number() over (partition by key order by rank, direction, ord) n from rows) where n = 1) as listed, count(distinct key) = (select count(*) from (select row_number() over (partition by key order by rank, direction, ord) n from rows) where n = 1) as holds from rows")
def screening_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screening.screened(read_table(spark, sf_dir, "papers"))
    return reports.screening_totals(rows, screening.flatten_unique(rows))


@query("select entry_id, case when m >= 3 then 'drop' when m >= 1 then 'warn' else 'ok' end as validity from (select entry_id, (coalesce(trim(citation_key), '') = '')::int + (coalesce(trim(作者), '') = '')::int + (coalesce(trim(年份), '') = '')::int + (coalesce(trim(分级), '') = '')::int as m from pool_entries)")
def entry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pool_entries")
    return rows.select("entry_id", reports.entry_validity([F.col("citation_key"), F.col("作者"), F.col("年份"), F.col("分级")]).alias("validity"))


@query("""select * from (with b as (select source_id, tags from source_papers), n as (select source_id from b where tags is null or len(list_filter(tags, lambda t: t is not null)) = 0) select 'NO_TAGS' as code, source_id::varchar as key from n)""")
def tag_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "source_papers")
    return reports.tag_checks(rows, "source_id", "tags", tags.groups(rows, "tags"))


@query("""select journal, source_id, rank() over (partition by journal order by len(citation_contexts) desc nulls last)::int as rank from source_papers where journal is not null""")
def journal_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "source_papers").where("journal is not null").select("journal", "source_id", F.when(F.col("citation_contexts").isNotNull(), F.size("citation_contexts")).alias("score"))
    return reports.journal_leaders(rows, "journal", "score").select("journal", "source_id", "rank")


@query("select doc_id, len(regexp_extract_all(text, '\\S+'))::bigint as words, len(regexp_extract_all(text, '\\\\begin\\{figure'))::bigint as figures, len(regexp_extract_all(text, '\\\\begin\\{table'))::bigint as tables, len(regexp_extract_all(text, '\\\\cite'))::bigint as citations from documents where source like 'manuscript%' and text is not null")
def manuscript_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("source like 'manuscript%' and text is not null")
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    return docs.select("doc_id", audits.words(F.col("text")).cast("long").alias("words"), count(r"\\begin\{figure").alias("figures"), count(r"\\begin\{table").alias("tables"), count(r"\\cite").alias("citations"))


@query("""with p as (select doc_id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, ' ') <> '') as ps from documents where lang = 'en' and text is not null)
    select doc_id, len(ps)::bigint as paragraphs, len(list_filter(ps, lambda p: len(list_filter(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ') <> '')) not between 4 and 8))::bigint as off_length from p""")
def paragraph_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of fewer than four or more than eight sentences."""
    parts = audits.paragraphs(F.col("text"))
    off = F.size(F.filter(parts, lambda p: ~F.size(audits.sentences(p)).between(4, 8)))
    return read_table(spark, sf_dir, "documents").where("lang = 'en' and text is not null").select("doc_id", F.size(parts).cast("long").alias("paragraphs"), off.cast("long").alias("off_length"))


@query("select doc_id, key from (with k as (select doc_id, text, unnest(regexp_extract_all(text, '(?m)^%?\\s*(TODO|FIXME|TBD)', 1)) as key from documents) select distinct doc_id, key from k)")
def open_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^%?\s*(TODO|FIXME|TBD)"), 1)).alias("key"))
    return rows.distinct()


@query(f"with {COMMENTS}, c as (select doc_id, 'R' || number || case when type = 'minor' then '-m' else '-' end || row_number() over (partition by doc_id, number, type order by block) as i from tx where length(text) >= 5) select count(*) as comments, count(distinct (doc_id, i)) as ids, count(*) filter (not regexp_matches(i, '^R\\d+-m?\\d+$')) as malformed from c")
def comment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, their distinct ids, and ids of a wrong form."""
    docs = read_table(spark, sf_dir, "documents").where("source = 'decision_letters'")
    comments = letters.comments(docs, "doc_id", "text").select("doc_id", "comment_id")
    return comments.agg(F.count(F.lit(1)).alias("comments"), F.countDistinct("doc_id", "comment_id").alias("ids"), F.count_if(~F.col("comment_id").rlike(r"^R\d+-m?\d+$")).alias("malformed"))


@query("select year, count(*) as n from (select nullif(regexp_extract(年份, '((?:19|20)\\d{2})', 1), '') as year from pool_entries) group by year")
def pool_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pool_entries").groupBy(F.nullif(X.year_in("年份"), F.lit("")).alias("year")).agg(F.count(F.lit(1)).alias("n"))



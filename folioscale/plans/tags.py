"""Queries of tags, work plans and the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.functions.tiers import TIERS, tier_name, tier_rank
from folioscale.operators import allocation, checks, letters, matching, tags
from folioscale.plans import sqltext as S
from folioscale.plans.registry import Registry
from folioscale.plans.screening import quota_sql
from folioscale.runtime import read_table

registry = Registry()
query = registry.query


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "source_papers").withColumn("rank", tier_rank("tier"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "dispatch_items")


_LONG = f"lt as (select source_id, journal, {S.RANK} as rank, unnest(tags) as tag from source_papers), lg as (select * from lt where tag is not null)"


@query(f"with {_LONG} select 'tag_tier' as kind, tag, rank, null as journal, count(*) as n from lg group by tag, rank union all select 'direction_tag', tag, null, journal, count(*) from lg group by tag, journal")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by tier, and by journal (which stands for the direction of a bibliography)."""
    return tags.counts(_sources(spark, sf_dir), "tags", "rank", "journal")


@query(f"with {_LONG} select {S.stats_group('tag')} as tag_group, count(*) as actual from lg group by 1")
def tag_group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.groups(_sources(spark, sf_dir), "tags")


@query(
    f"""with {_LONG}, g as (select {S.stats_group('tag')} as tag_group, count(*) as actual from lg group by 1), t as (select * from (values ('BG', 50), ('LR', 150), ('GAP', 75), ('METHOD', 60), ('DISC', 65)) v(tag_group, target)),
    r as (select tag_group, target, coalesce(actual, 0) as actual, coalesce(actual, 0) / target::double * 100 as rate from t left join g using (tag_group))
    select *, case when round(rate, 1) >= 80 then '✅' when round(rate, 1) >= 50 then '⚠️' else '❌' end as status from r"""
)
def tag_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.adequacy(_sources(spark, sf_dir), "tags")


@query(f"with {_LONG} select tag, count(*) filter (rank = 0) as core, count(*) filter (rank = 1) as important, count(*) filter (rank = 2) as backup from lg group by tag")
def tag_tier_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sources(spark, sf_dir).select(F.explode("tags").alias("tag"), tier_name("tier").alias("tier")).where("tag is not null")
    return rows.groupBy("tag").pivot("tier", list(TIERS)).count().na.fill(0)


@query(f"with {_LONG} select journal, {', '.join(f'''count(*) filter ({S.stats_group('tag')} = '{g}') as {g}''' for g in tags.ADEQUACY)} from lg group by journal")
def journal_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.matrix(_sources(spark, sf_dir), "tags", "journal", list(tags.ADEQUACY), X.stats_group("tag"))


@query("""select source_id, len(list_filter(tags, lambda t: contains(lower(t), 'rq1')))::bigint + len(list_filter(tags, lambda t: contains(lower(t), 'method')))::bigint as hits from source_papers
    where tags is not null and (len(list_filter(tags, lambda t: contains(lower(t), 'rq1'))) > 0 or len(list_filter(tags, lambda t: contains(lower(t), 'method'))) > 0)""")
def tag_search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.search(_sources(spark, sf_dir), "tags", ["RQ1", "method"]).select("source_id", "hits")


@query("""select source_id, len(list_filter(tags, lambda t: contains(lower(t), 'gap')))::bigint + len(list_filter(tags, lambda t: contains(lower(t), 'rq')))::bigint as hits from source_papers
    where tags is not null and len(list_filter(tags, lambda t: contains(lower(t), 'gap'))) > 0 and len(list_filter(tags, lambda t: contains(lower(t), 'rq'))) > 0""")
def tag_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.search(_sources(spark, sf_dir), "tags", ["gap", "rq"], every=True).select("source_id", "hits")


_VOCABULARY = "[" + ", ".join(f"'{tag}'" for tag in tags.VOCABULARY) + "]"


@query(f"select item_id, list_filter(list_transform(tags, lambda t: case when regexp_matches({S.strip('t')}, '^BG\\s*\\(') then 'BG' else {S.strip('t')} end), lambda t: list_contains({_VOCABULARY}, t)) as tags from dispatch_items where tags is not null")
def valid_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).where("tags is not null").select("item_id", tags.valid("tags").alias("tags"))


@query("""with t as (select distinct trim(unnest(string_split(标签, '+'))) as tag, citation_key from pool_entries where 标签 is not null and citation_key is not null)
    select citation_key, list_sort(list(tag)) as tags from t where tag <> '' group by citation_key""")
def multi_file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "pool_entries").where("`标签` is not null and citation_key is not null").select("citation_key", F.explode(F.split("标签", r"\+")).alias("tag"))
    return rows.withColumn("tag", F.trim("tag")).where("tag <> ''").distinct().groupBy("citation_key").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


@query(f"""with t as (select distinct entry_id, trim(unnest(string_split(标签, '+'))) as tag, citation_key, 年份, lower(trim(分级)) as g from pool_entries where 标签 is not null and citation_key is not null),
    f as (select *, row_number() over (partition by tag, citation_key order by entry_id) as n from t where tag <> '')
    select {S.quota_group('tag')} || '.md' as file, tag, citation_key, entry_id, case when g in ('核心', 'core') then '核心' when g in ('重要', 'important') then '重要' when g in ('备选', 'backup') then '备选' end as grade from f where n = 1""")
def pool_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries fanned out to their tags, the first of each key in a tag, with file and grade."""
    rows = read_table(spark, sf_dir, "pool_entries").where("`标签` is not null and citation_key is not null").select("entry_id", F.explode(F.split("标签", r"\+")).alias("tag"), "citation_key", X.grade("分级").alias("grade"))
    rows = rows.withColumn("tag", F.trim("tag")).where("tag <> ''")
    first = rows.groupBy("tag", "citation_key").agg(F.min_by(F.struct("entry_id", "grade"), "entry_id").alias("e"))
    return first.select(X.pool_file("tag").alias("file"), "tag", "citation_key", "e.entry_id", F.when(F.col("e.grade").isin("核心", "重要", "备选"), F.col("e.grade")).alias("grade"))


@query("""with b as (select item_id, item_count, batch_limit, ceil(item_count / batch_limit::double)::bigint as parts from dispatch_items where item_count > 0 and batch_limit > 0),
    p as (select *, ceil(item_count / parts::double)::bigint as size, unnest(range(1, parts + 1)) as part from b)
    select item_id, part, parts, (part - 1) * size + 1 as range_start, least(part * size, item_count)::bigint as range_end, least(part * size, item_count)::bigint - (part - 1) * size as part_count from p""")
def split_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = allocation.split_work(_items(spark, sf_dir), "item_count", "batch_limit")
    return parts.select("item_id", "part", "parts", "range_start", "range_end", "part_count")


@query("""with b as (select item_id, plan_id, source_file, ceil(item_count / batch_limit::double)::bigint as parts from dispatch_items where item_count > 0 and batch_limit > 0 and plan_id is not null),
    p as (select *, unnest(range(1, parts + 1)) as part from b)
    select item_id, part, case when contains(source_file, '_cnki') then 'cnki' else 'wos' end as source_type, row_number() over (partition by plan_id order by item_id, part) as batch_seq from p""")
def batch_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = allocation.split_work(_items(spark, sf_dir).where("plan_id is not null"), "item_count", "batch_limit")
    numbered = allocation.batch_sequence(parts, "plan_id", ["item_id", "part"])
    return numbered.select("item_id", "part", F.when(F.contains("source_file", F.lit("_cnki")), "cnki").otherwise("wos").alias("source_type"), F.col("batch_seq").cast("long").alias("batch_seq"))


@query("""with recursive per as (select plan_id, batch_limit, tag, count(*) as n from (select plan_id, batch_limit, unnest(tags) as tag from dispatch_items where item_count > 0) where tag is not null and plan_id is not null and batch_limit > 0 group by all),
    big as (select plan_id, tag, n, row_number() over (partition by plan_id order by tag) as bin from per where n > batch_limit // 2), many as (select plan_id, count(*) as c from big group by plan_id),
    small as (select *, row_number() over (partition by plan_id order by n desc, tag) as k from per where n <= batch_limit // 2),
    fit as (select distinct plan_id, 0::bigint as k, '' as tag, 0::bigint as n, 0::bigint as bin, []::bigint[] as rooms from small union all
      select plan_id, k, tag, n, coalesce(slot, len(rooms) + 1)::bigint, case when slot is null then list_append(rooms, room - n) else list_transform(rooms, lambda r, i: case when i = slot then r - n else r end) end
      from (select f.plan_id, s.k, s.tag, s.n, f.rooms, s.batch_limit::bigint as room, nullif(list_position(list_transform(f.rooms, lambda r: r >= s.n), true), 0) as slot from fit f join small s on s.plan_id = f.plan_id and s.k = f.k + 1))
    select plan_id, tag, n, bin from big union all select plan_id, tag, n, bin + coalesce(c, 0) from fit left join many using (plan_id) where k > 0""")
def first_fit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a plan packed first-fit by falling count, as agents are given work."""
    counts = _items(spark, sf_dir).where("item_count > 0").select("plan_id", "batch_limit", F.explode("tags").alias("tag"), "item_count").where("tag is not null")
    per_tag = counts.groupBy("plan_id", "batch_limit", "tag").agg(F.count(F.lit(1)).alias("n"))
    return allocation.first_fit(per_tag, "plan_id", "tag", "n", "batch_limit")


@query("""select plan_id, item_id, (round_even(6000 * item_count / sum(item_count) over (partition by plan_id) * (case when len(tags) > 1 then 1.1::double else 1.0::double end) / 50, 0) * 50)::bigint as words from dispatch_items where item_count > 0""")
def word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6000 words shared by the counts of a plan's items; several tags count as heavy."""
    rows = _items(spark, sf_dir).where("item_count > 0").select("plan_id", "item_id", F.lit(6000).alias("total"), "item_count", F.coalesce(F.size("tags") > 1, F.lit(False)).alias("heavy"))
    return allocation.word_budget(rows, "total", "item_count", "heavy", "plan_id").select("plan_id", "item_id", "words")


@query("""with c as (select source_id, unnest(citation_contexts) as c from source_papers), s as (select source_id, count(distinct lower(c.section)) as n from c where c.section is not null group by source_id)
    select p.source_id, case when coalesce(n, 0) >= 3 then 'core' when n = 2 then 'important' else 'backup' end as tier from source_papers p left join s using (source_id)""")
def tier_by_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier of a source by how many sections cite it."""
    n = F.size(F.array_distinct(F.filter(F.transform("citation_contexts", lambda c: F.lower(c["section"])), lambda s: s.isNotNull())))
    return _sources(spark, sf_dir).select("source_id", F.when(n >= 3, "core").when(n == 2, "important").otherwise("backup").alias("tier"))


def _section_case(text: str) -> str:
    cases = " ".join(f"when contains({text}, '{keyword}') then [{', '.join(repr(t) for t in (values or ('LR',)))}]" for keyword, values in letters.SECTION_TAGS)
    return f"case {cases} else ['LR'] end"


@query(
    f"""with c as (select source_id, unnest(citation_contexts) as c from source_papers), t as (select source_id, concat_ws(' ', lower(coalesce(c.section, '')), lower(coalesce(c.subsection, ''))) as x from c),
    g as (select source_id, x, unnest({_section_case('x')}) as tag from t), e as (select source_id, unnest(case when tag <> 'DISC' then [tag] else (case when len(q) > 0 then q else ['DISC-RQ1', 'DISC-RQ2', 'DISC-RQ3'] end) end) as tag from (select *, list_filter([{', '.join(f"case when {' or '.join(f'''contains(x, '{w}')''' for w in words)} then 'DISC-RQ{rq}' end" for rq, words in letters.QUESTION_WORDS.items())}], lambda z: z is not null) as q from g))
    select source_id, list_sort(list(distinct tag)) as tags from e group by source_id"""
)
def section_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of a source by the sections that cite it, with three research questions."""
    rows = _sources(spark, sf_dir).select("source_id", F.explode("citation_contexts").alias("c"))
    rows = rows.select("source_id", F.explode(letters.section_tags(F.col("c.section"), F.col("c.subsection"), 3)).alias("tag")).distinct()
    return rows.groupBy("source_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


@query("""with k as (select entry_id, citation_key, 年份 as y from pool_entries) select entry_id, nullif(regexp_extract(citation_key, '(\\d{4})', 1), '') = nullif(regexp_extract(y, '(\\d{4})', 1), '') as agrees from k""")
def key_year_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pool_entries").select("entry_id", X.key_year_agrees("citation_key", "年份").alias("agrees"))


_PLACEHOLDER = "coalesce(lower(trim(作者)), '') in ('unknown', 'unk', 'n/a', 'na', 'tbd', 'anon', 'anonymous', '')"


@query(f"""with p as (select entry_id, citation_key, 标签, 作者, coalesce(citation_key, '') as k from pool_entries)
    select 'KEY_FORMAT' as code, entry_id::varchar as key from p where not regexp_matches(k, '^[a-z][a-z0-9]*\\d{{4}}[a-z][a-z]?$') union all
    select 'KEY_DUPLICATE', citation_key from p where citation_key is not null group by citation_key having count(*) > 1 union all
    select 'NO_TAGS', entry_id::varchar from p where coalesce(trim(标签), '') = '' union all
    select 'PLACEHOLDER_AUTHOR', entry_id::varchar from p where {_PLACEHOLDER}""")
def pool_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.pool(read_table(spark, sf_dir, "pool_entries"))


@query(
    lambda: f"""with {quota_sql('(select count(*) * 30 from directions)')}, e as (select id, len(list_filter(coalesce(tags, []), lambda t: t is not null)) as n from directions)
    select 'NO_TAGS' as code, id::varchar as key from e where n = 0 union all select 'MIN_VIOLATION', id::varchar from quotas where quota < 20 union all
    select 'TAG_UNCOVERED', t from (select unnest(['BG', 'LR', 'METHOD', 'GAP', 'DISC']) as t) where t not in (select tag_group from grp)"""
)
def quota_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, minimum, tiers, coverage and tags of an apportionment (scaling may leave a quota under the minimum)."""
    directions = read_table(spark, sf_dir, "directions")
    each = F.count(F.lit(1))
    quotas = allocation.tier_split(allocation.apportion(directions, each.over(Window.partitionBy(F.lit(0))) * 30).select("id", "quota"))
    return checks.quotas(quotas, directions, each * 30)


@query("""select code, item_id::varchar as key from (select 'OVER_LIMIT' as code, item_id from dispatch_items where item_count > batch_limit and batch_limit > 0 union all
    select 'MISSING_COVERAGE', item_id from dispatch_items where item_count > 0 and batch_limit > 0 and plan_id is null union all
    select 'COUNT_MISMATCH', item_id from dispatch_items where item_count > 0 and batch_limit > 0 and plan_id is not null and plan_id % 7 = 0)""")
def dispatch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that is wrong on purpose: no item is split, items without a plan are left out, every seventh plan loses a record."""
    items = _items(spark, sf_dir)
    parts = items.where("item_count > 0 and batch_limit > 0 and plan_id is not null").withColumn("part_count", F.col("item_count") - F.when(F.col("plan_id") % 7 == 0, 1).otherwise(0))
    over = items.where("item_count > batch_limit and batch_limit > 0").withColumn("part_count", F.col("item_count"))
    found = checks.dispatch(items, parts, "item_id", "item_count", "batch_limit").where("code <> 'OVER_LIMIT'")
    return found.unionByName(checks.dispatch(items, over, "item_id", "item_count", "batch_limit").where("code = 'OVER_LIMIT'"))


@query("""with s as (select item_id, item_count, batch_limit, ceil(item_count / batch_limit::double) as n from dispatch_items where item_count > 0 and batch_limit > 0)
    select count(*) as items, sum(n)::bigint as parts, sum(item_count)::bigint as records, 0::bigint as violations from s""")
def dispatch_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splitting keeps the limit, the counts and every item."""
    items = _items(spark, sf_dir)
    parts = allocation.split_work(items, "item_count", "batch_limit")
    found = checks.dispatch(items, parts, "item_id", "item_count", "batch_limit").select(F.lit(None).alias("item_id"), F.lit(0).alias("part_count"), F.lit(True).alias("wrong"))
    both = parts.select("item_id", "part_count", F.lit(False).alias("wrong")).unionByName(found)
    return both.agg(F.countDistinct("item_id").alias("items"), F.count_if(~F.col("wrong")).alias("parts"), F.sum("part_count").alias("records"), F.count_if("wrong").alias("violations"))


@query("""with r as (select year, count(*) as n from papers where year is not null group by year)
    select min(year) as first_year, max(year) as last_year, sum(n)::bigint as dated, sum(case when year >= 2020 then n else 0 end)::bigint as recent, sum(case when year >= 2020 then n else 0 end) / sum(n)::double as share from r""")
def year_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "papers").where("year is not null")
    recent = F.count_if(F.col("year") >= 2020)
    return rows.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("dated"), recent.alias("recent"), (recent / F.count(F.lit(1))).alias("share"))


@query("select concat_ws('|', year, lower(trim(title))) as key, count(*) as n, min(paper_id) as first_id from papers where title is not null and year is not null group by 1 having count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "papers").where("title is not null and year is not null")
    return matching.duplicate_groups(rows, F.concat_ws("|", F.col("year").cast("string"), F.lower(F.trim("title"))), "paper_id")


@query(lambda: f"with {S.nfkd_table()} select {S.normalize('journal')} as form, count(distinct journal) as spellings, count(*) as n from papers, nf where journal is not null group by 1 having count(distinct journal) > 1 and form <> ''")
def journal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.variants(read_table(spark, sf_dir, "papers"), "journal")


@query("""select entry_id, citation_key, 标签 as tag, n::int as place from (select entry_id, citation_key, 标签, row_number() over (partition by 标签 order by case lower(trim(分级)) when 'core' then 0 when '核心' then 0 when 'important' then 1 when '重要' then 1 else 2 end, nullif(regexp_extract(年份, '((?:19|20)\\d{2})', 1), '') desc nulls last, entry_id) as n from pool_entries where 标签 is not null) where n <= 8""")
def leading_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading entries of each tag by grade, then year."""
    rows = read_table(spark, sf_dir, "pool_entries").where("`标签` is not null").withColumns({"rank": tier_rank("分级"), "y": F.nullif(X.year_in("年份"), F.lit(""))})
    return matching.leading(rows, "标签", [F.col("rank"), F.col("y").desc_nulls_last(), F.col("entry_id")], 8).select("entry_id", "citation_key", F.col("标签").alias("tag"), "place")


@query("""with s as (select source_type, count(*) as n, sum(length(title))::bigint as chars from papers group by source_type) select source_type, n, chars, n / sum(n) over ()::double as share from s""")
def source_type_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "papers").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("title")).alias("chars"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


@query("""with f as (select direction, avg((relevance >= 500)::int) as share, avg((year >= 2015)::int) as recent from papers where direction is not null group by direction)
    select direction, case when recent >= 0.9 then 'ok' when share >= 0.6 then 'must fix' when share >= 0.3 then 'strengthen' else 'pre-empt' end as advice from f where share is not null and recent is not null""")
def prevalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.operators.audits import prevalence

    rows = read_table(spark, sf_dir, "papers").where("direction is not null").groupBy("direction").agg(F.avg((F.col("relevance") >= 500).cast("int")).alias("share"), F.avg((F.col("year") >= 2015).cast("int")).alias("recent"))
    return rows.where("share is not null and recent is not null").select("direction", prevalence(F.col("share"), F.col("recent") >= 0.9).alias("advice"))


@query("""select * from (with b as (select unnest(string_split(lower(title), ' ')) as token from papers), a as (select unnest(string_split(lower(title), ' ')) as token from merged_papers),
    l as (select token from b except all select token from a), g as (select token from a except all select token from b)
    select token, count(*) as n, 'lost' as change from l group by token union all select token, count(*), 'gained' from g group by token)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of titles before and after merging, duplicates counting."""
    tokens = lambda name: read_table(spark, sf_dir, name).select(F.explode(F.split(F.lower("title"), " ")).alias("token"))
    return matching.multiset_difference(tokens("papers"), tokens("merged_papers"))

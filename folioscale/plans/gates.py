"""Queries of joins, orders, gates and runs: what the other modules of queries leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.functions.tiers import tier_rank
from folioscale.operators import allocation, audits, checks, judge, letters, matching, reports, tags
from folioscale.plans import sqltext as S
from folioscale.plans.registry import Registry
from folioscale.runtime import cut_lineage, read_table, shared_path
from folioscale.sinks import writers
from folioscale.sources.works import read_works
from folioscale.streaming import incremental

registry = Registry()
query = registry.query


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "papers")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@query("select direction, count(*) as n from papers where direction in (1, 3, 5) group by direction")
def direction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).where(F.col("direction").isin(1, 3, 5)).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query("select direction, count(*) as n, count(tags) as tagged, count(reason) as reasons from (select direction, null as tags, reason from papers union all select 0, tags, null from source_papers) group by direction")
def batch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened records and those of the bibliography, as direction 0, under one another."""
    sources = read_table(spark, sf_dir, "source_papers").select(F.lit(0).alias("direction"), "tags")
    rows = _papers(spark, sf_dir).select("direction", "reason").unionByName(sources, allowMissingColumns=True)
    return rows.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.count("tags").alias("tagged"), F.count("reason").alias("reasons"))


_CITED = "c as (select distinct key from (select trim(unnest(string_split(g, ','))) as key from (select unnest(regexp_extract_all(line, '\\\\(?:cite|citep|citet|citeN|parencite|textcite)\\*?(?:\\[[^\\]]*\\])*\\{([^}]*)\\}', 1)) as g, line from (select unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) as line from documents where text is not null) where not regexp_matches(line, '^\\s*%') and not regexp_matches(line, '\\\\(section|subsection)\\*?\\{'))) where key <> '')"


@query(f"with {_CITED}, e as (select citation_key as key, max(nullif(regexp_extract(年份, '((?:19|20)\\d{{2}})', 1), '')::int) as year from pool_entries where citation_key is not null group by 1) select c.key, e.year, 'dated' as state from c join e using (key) where year > 0 union all select key, null, 'absent' from c where key not in (select key from e)")
def cited_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys cited in documents with the year of their entry, and keys without an entry; entries without a year are in neither."""
    cites = letters.latex_citations(_docs(spark, sf_dir), "doc_id", "text").select("key").distinct()
    entries = read_table(spark, sf_dir, "pool_entries").where("citation_key is not null").groupBy(F.col("citation_key").alias("key")).agg(F.max(F.nullif(X.year_in("年份"), F.lit("")).cast("int")).alias("year"))
    dated, absent = reports.cited_entries(cites, entries, "key")
    return dated.select("key", "year", F.lit("dated").alias("state")).unionByName(absent.select("key", F.lit(None).cast("int").alias("year"), F.lit("absent").alias("state")))


@query("""select item_id, case when case when contains(source_file, '_cnki') then 'cnki' else 'wos' end = 'cnki' and source_directions[1] % 2 = 0 then 8 when source_directions[1] % 5 <> 0 then (20 + source_directions[1])::int end::int as quota from dispatch_items where source_directions[1] is not null""")
def own_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of agents: that of their direction and source where there is one, else that of the direction."""
    agents = read_table(spark, sf_dir, "dispatch_items").select("item_id", F.get("source_directions", F.lit(0)).alias("direction"), F.when(F.contains("source_file", F.lit("_cnki")), "cnki").otherwise("wos").alias("source_type")).where("direction is not null")
    ids = agents.select("direction").distinct()
    plan = ids.where("direction % 5 <> 0").withColumn("quota", F.col("direction") + 20)
    by_source = ids.where("direction % 2 = 0").select("direction", F.lit("cnki").alias("source_type"), F.lit(8).alias("quota"))
    return reports.own_quotas(agents, plan, by_source).select("item_id", "quota")


_FORM = "trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex({}, '\\s+'), lambda w: w not in ('a', 'an', 'the')), ' '), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))".format
_CUT = "regexp_replace(replace(lower(trim({})), '&', 'and'), '^\\d+(\\.\\d+)*\\.?\\s*', '')".format


@query(
    lambda: f"""with sec as (select doc_id, row_number() over (partition by doc_id order by line_no) as node_id, title from (select doc_id, line_no, regexp_extract(line, '^[^%]*?\\\\(section|subsection|subsubsection)\\*?\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', 1) as cmd, regexp_extract(line, '^[^%]*?\\\\(section|subsection|subsubsection)\\*?\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', 2) as title
      from (select doc_id, generate_subscripts(ls, 1) as line_no, unnest(ls) as line from (select doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) as ls from documents where text is not null))) where cmd <> ''),
    n as (select doc_id, node_id, lower(trim(title)) as t, {_FORM(_CUT('title'))} as tf from sec),
    q as (select doc_id, node_id as query_id, case node_id % 4 when 0 then upper(title) when 1 then 'The ' || title when 2 then left(title, 6) else 'no such heading' end as query from sec),
    f as (select doc_id, query_id, lower(trim(query)) as q, {_FORM(_CUT('query'))} as qf from q),
    j as (select f.doc_id, query_id, n.node_id, case when q = t then 1 when qf = tf then 2 when length(qf) >= 3 and (contains(tf, qf) or contains(qf, tf)) then 3 end as strategy from f join n using (doc_id)),
    b as (select doc_id, query_id, min(strategy) as strategy from j where strategy is not null group by all)
    select doc_id, query_id, min(node_id)::bigint as node_id, strategy from j join b using (doc_id, query_id, strategy) group by doc_id, query_id, strategy"""
)
def section_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings looked for in their manuscripts under other forms: capitals, with an article, their first letters, or wrongly."""
    nodes = cut_lineage(letters.latex_sections(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.col("node").alias("node_id"), "title"))
    kind = F.col("node_id") % 4
    asked = F.when(kind == 0, F.upper("title")).when(kind == 1, F.concat(F.lit("The "), "title")).when(kind == 2, F.left("title", F.lit(6))).otherwise("no such heading")
    return matching.match_sections(nodes.select("doc_id", F.col("node_id").alias("query_id"), asked.alias("query")), nodes)


@query("select source_id, coalesce(case when source_id % 2 = 0 then (select max(rec_id) from merged_papers m where m.dedup_key = s.dedup_key) end, (select max(rec_id) from merged_papers m where m.title = s.title))::bigint as rec_id from source_papers s")
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records of a bibliography by key where there is one (every second record), else by title."""
    merged = read_table(spark, sf_dir, "merged_papers").select("rec_id", "dedup_key", "title")
    by_key = merged.where("dedup_key is not null").groupBy(F.col("dedup_key").alias("key")).agg(F.max("rec_id").alias("own"))
    by_title = merged.where("title is not null").groupBy("title").agg(F.max("rec_id").alias("other"))
    probe = read_table(spark, sf_dir, "source_papers").select("source_id", F.when(F.col("source_id") % 2 == 0, F.col("dedup_key")).alias("key"), "title")
    return probe.join(by_key, "key", "left").join(by_title, "title", "left").select("source_id", F.coalesce("own", "other").alias("rec_id"))


@query("select p.paper_id, j.id from papers p join journals j on j.name = p.journal where len(list_filter(j.tags, lambda t: contains(t, '湿地'))) > 0")
def journals_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the journals that have a tag, whatever its case."""
    chosen = tags.search(read_table(spark, sf_dir, "journals"), "tags", ["湿地"]).select("id", F.col("name").alias("journal"))
    return _papers(spark, sf_dir).select("paper_id", "journal").join(F.broadcast(chosen), "journal").select("paper_id", "id")


@query(f"""select direction, paper_id, place::int as place from (select direction, paper_id, row_number() over (partition by direction order by relevance desc nulls last, coalesce(year > 2019, false) desc, {S.RANK}, contains(coalesce(reason, ''), 'method') desc, paper_id) as place from papers where direction is not null) where place <= 12""")
def overflow_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve records a direction where more are wanted than fit: relevance stands for citations, the tier for the journal."""
    rows = _papers(spark, sf_dir).where("direction is not null").withColumn("rank", tier_rank("tier"))
    kept = reports.overflow(rows, "direction", F.lit(12), F.col("relevance"), F.col("year"), F.col("rank"), F.contains(F.coalesce("reason", F.lit("")), F.lit("method")), 2024, "paper_id")
    return kept.select("direction", "paper_id", "place")


@query("""select plan_id, item_id, row_number() over (partition by plan_id order by case item_id % 5 when 0 then 2 when 1 then 0 when 2 then 3 when 3 then 1 else 4 end, item_id)::int as place from dispatch_items where plan_id is not null""")
def severity_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items as issues of their plan, the severe ones first."""
    names = F.array(*[F.lit(x) for x in ("green", "red", "structural", "yellow", "other")])
    issues = read_table(spark, sf_dir, "dispatch_items").where("plan_id is not null").select("plan_id", "item_id", F.element_at(names, (F.col("item_id") % 5 + 1).cast("int")).alias("severity"))
    return reports.severity_queue(issues, "severity", "item_id", "plan_id").select("plan_id", "item_id", "place")


@query("select item_id, 1::bigint as part, item_count::bigint as part_count from dispatch_items where item_count > 0")
def report_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work for reports, which is never split: the limit is one more than the largest count."""
    items = read_table(spark, sf_dir, "dispatch_items").where("item_count > 0")
    most = F.broadcast(items.agg((F.max("item_count") + 1).alias("most"), F.lit(1).alias("k")))
    parts = allocation.split_work(items.withColumn("k", F.lit(1)).join(most, "k"), "item_count", "most")
    return parts.select("item_id", "part", "part_count")


@query("select plan_id, item_id, item_count * case when item_id = max(item_id) over (partition by plan_id) then 1.2::double else 1.0::double end as weighted from dispatch_items where plan_id is not null")
def last_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last item of a plan gets a fifth more."""
    items = read_table(spark, sf_dir, "dispatch_items").where("plan_id is not null").select("plan_id", "item_id", "item_count")
    return allocation.last_weighted(items, "item_count", "plan_id", "item_id").select("plan_id", "item_id", "weighted")


@query("""with s as (select n_nationkey, n_nationkey // 5 + 1 as stage, n_regionkey = 0 as is_global from nation)
    select n_nationkey as cluster, stage::int as stage, row_number() over (order by stage, is_global desc, n_nationkey)::int as place from s""")
def work_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clusters of work, each needing the one five numbers below; those of one region are global."""
    nation = read_table(spark, sf_dir, "nation")
    clusters = nation.select(F.col("n_nationkey").alias("cluster"), (F.col("n_regionkey") == 0).alias("is_global"))
    edges = nation.where("n_nationkey >= 5").select(F.col("n_nationkey").alias("cluster"), (F.col("n_nationkey") - 5).alias("needs"))
    return reports.work_order(clusters, edges).select("cluster", "stage", "place")


@query("select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n'), lambda s: trim(s, ' ') <> '' and regexp_matches(s, '^(?:[0-9]|Fig\\.)')))::bigint as bad_starts from documents where text is not null")
def bad_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that begin with a number or an abbreviated figure."""
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(F.filter(audits.sentences(F.col("text")), lambda s: s.rlike(audits.BAD_START))).cast("long").alias("bad_starts"))


@query("with p as (select direction, length(reason) as n from papers where direction is not null and reason is not null) select direction, max(n) >= 1.5::double * min(n) as balanced from p group by direction having count(*) > 1")
def balanced_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the reasons of a direction, as its points, differ enough in length."""
    return reports.balanced_points(_papers(spark, sf_dir).where("direction is not null and reason is not null"), "direction", "reason")


@query("""with s as (select paper_id as doc_id, 'p' || paper_id % 3 as part, 's' || n as section, case paper_id % 4 when 0 then '---' when 1 then coalesce(title, '') when 2 then repeat('x', 1200) || chr(10) || '---' else 'fine' || chr(10) || '---' end as text from papers, (select unnest(range(1, case when paper_id % 10 = 0 then 10 else 2 end)) as n)),
    b as (select *, regexp_matches(text, '---\\s*$') as ruled, trim(regexp_replace(text, '\\s*---\\s*$', ''), ' ' || chr(10) || chr(9) || '　') as body from s)
    select doc_id, section, problem from (select doc_id, section, unnest([case when body = '' then 'empty' end, case when not ruled then 'no rule at the end' end, case when length(body) > 1000 then 'too long' end]) as problem from b) where problem is not null
    union all select doc_id, part, 'too many sections' from s group by doc_id, part having count(*) > 8""")
def note_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of notes made of records: empty ones, without a closing rule, too long, or too many."""
    kind = F.col("paper_id") % 4
    text = F.when(kind == 0, "---").when(kind == 1, F.coalesce("title", F.lit(""))).when(kind == 2, F.concat(F.repeat(F.lit("x"), F.lit(1200)), F.lit("\n---"))).otherwise("fine\n---")
    many = F.explode(F.sequence(F.lit(1), F.when(F.col("paper_id") % 10 == 0, 9).otherwise(1))).alias("n")
    rows = _papers(spark, sf_dir).select(F.col("paper_id").alias("doc_id"), F.concat(F.lit("p"), (F.col("paper_id") % 3).cast("string")).alias("part"), text.alias("text"), many)
    return reports.note_lint(rows.withColumn("section", F.concat(F.lit("s"), F.col("n").cast("string"))))


@query("""with p as (select doc_id, case when doc_id % 2 = 0 then 'Conclusion' else 'Abstract' end as part, text from documents where text is not null and doc_id % 5 <> 0),
    w as (select doc_id, part, text, len(regexp_extract_all(regexp_replace(text, '\\\\[A-Za-z]+\\*?(?:\\[[^\\]]*\\])*|[{}%]', ' ', 'g'), '\\S+'))::bigint as words from p)
    select doc_id, part, words, words < case part when 'Conclusion' then 150 else 120 end as short, regexp_matches(text, '(?i)\\btodo\\b|XXX|FIXME|\\bTBD\\b|\\\\textcolor\\{red\\}|\\?\\?\\?') as unfinished from w""")
def short_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken as conclusions and abstracts: their words, and whether these are too few or unfinished. Other parts are not judged."""
    part = F.when(F.col("doc_id") % 5 == 0, "Method").when(F.col("doc_id") % 2 == 0, "Conclusion").otherwise("Abstract")
    rows = _docs(spark, sf_dir).where("text is not null").withColumn("part", part)
    return audits.short_parts(rows, "part", "text").select("doc_id", "part", "words", "short", "unfinished")


@query("""with l as (select doc_id, generate_subscripts(ls, 1)::bigint as line_no, unnest(ls) as line from (select doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) as ls from documents where text is not null))
    select doc_id, line_no, w as word from l, (select unnest(['carbon', '面板数据', 'a.b']) as w) where contains(line, w)""")
def listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with words of a run's own list, in which blank lines and comments stand as well."""
    words = spark.createDataFrame([("carbon",), ("面板数据",), ("",), ("# a comment",), (None,), ("a.b",)], "word string")
    return audits.listed_words(letters.lines(_docs(spark, sf_dir), "doc_id", "text"), words).withColumn("line_no", F.col("line_no").cast("long"))


@query("select journal, year::varchar as volume, count(*) as papers, sum(length(title))::bigint as figures from papers where journal is not null and year is not null group by rollup (journal, year)")
def harvest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by journal and year, as a harvest by volume; letters of titles stand for figures."""
    rows = _papers(spark, sf_dir).where("journal is not null and year is not null").withColumn("volume", F.col("year").cast("string"))
    return reports.harvest_totals(rows, "journal", "volume", F.lit(1), F.length("title"))


@query("""with r as (select p_partkey as run, (p_size % 7)::double as wanted from part), a as (select p_partkey as run, list_filter(['directions.json', case when p_partkey % 3 <> 0 then 'selected.json' end, 'workflow.json', case when p_partkey % 5 <> 0 then 'drafts/blog-draft.md' end, case when p_partkey % 7 <> 0 then 'sensitive-words.txt' end, 'drafts/self-audit.log'], lambda x: x is not null) as have from part),
    n as (select unnest([{'p': 2.0, 'n': 'directions.json'}, {'p': 2.0, 'n': 'selected.json'}, {'p': 3.0, 'n': 'workflow.json'}, {'p': 4.0, 'n': 'drafts/blog-draft.md'}, {'p': 4.5, 'n': 'sensitive-words.txt'}, {'p': 5.0, 'n': 'drafts/self-audit.log'}, {'p': 6.0, 'n': 'images/image-manifest.json'}], recursive := true)),
    l as (select run, wanted, p, n from r join a using (run), n where p <= wanted and not list_contains(have, n)),
    f as (select run, min(p) as first, count(*) as lacking from l group by run)
    select r.run, r.wanted, case when f.run is null then r.wanted when first = 2 then 0 when first = 3 then 2 when first = 4 then 3 when first = 4.5 then 4 when first = 5 then 4.5 else 5 end::double as phase, coalesce(lacking, 0)::int as lacking from r left join f using (run)""")
def resume_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which phase runs may go on, going by the artifacts they left; parts stand for runs."""
    part = read_table(spark, sf_dir, "part")
    have = F.array_compact(F.array(F.lit("directions.json"), F.when(F.col("p_partkey") % 3 != 0, "selected.json"), F.lit("workflow.json"), F.when(F.col("p_partkey") % 5 != 0, "drafts/blog-draft.md"), F.when(F.col("p_partkey") % 7 != 0, "sensitive-words.txt"), F.lit("drafts/self-audit.log")))
    runs = part.select(F.col("p_partkey").alias("run"), (F.col("p_size") % 7).cast("double").alias("wanted"))
    found = reports.resume_phase(runs, part.select(F.col("p_partkey").alias("run"), F.explode(have).alias("name")), "run", "wanted", "name")
    return found.select("run", "wanted", "phase", F.size("missing").alias("lacking"))


@query("""with f as (select source as project, doc_id, case doc_id % 4 when 0 then 'manuscript.tex' when 1 then 'structure/3_x/a.md' when 2 then 'structure/4_y/b_dev.md' else 'other.txt' end as path, length(regexp_replace(coalesce(text, ''), '(?m)^\\s*%.*$', '', 'g')) as n from documents where source not like 'manuscript%' and source <> 'thesis_drafts' and not contains(coalesce(text, ''), '%'))
    select project, case when bool_or(path = 'manuscript.tex' and n > 500 and project < 'm') then 'C' when bool_or(path = 'structure/3_x/a.md' and n > 500) then 'B' when bool_or(path = 'structure/4_y/b_dev.md' and n > 500) then 'A' else 'none' end as stage from f group by project""")
def project_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far projects are, sources standing for projects; only those before m in the alphabet have a manuscript."""
    kind = F.col("doc_id") % 4
    path = F.when((kind == 0) & (F.col("source") < "m"), "manuscript.tex").when(kind == 1, "structure/3_x/a.md").when(kind == 2, "structure/4_y/b_dev.md").otherwise("other.txt")
    files = _docs(spark, sf_dir).where("source not like 'manuscript%' and source <> 'thesis_drafts' and not contains(coalesce(text, ''), '%')").select(F.col("source").alias("project"), path.alias("path"), "text")
    return reports.project_stage(files, "project", "path", "text")


@query("select openalex_id as source_id, count(*) as works, max('2024-03-' || lpad((n % 28 + 1)::varchar, 2, '0')) as latest from (select openalex_id, unnest(range(0, length(name) * 3)) as n from journals where openalex_id is not null) group by openalex_id")
def works_of_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of the journals from a stub of the service, thrice as many as their names have letters, seven to a page."""
    journals = read_table(spark, sf_dir, "journals").where("openalex_id is not null").select("openalex_id", "name").collect()  # a dimension of 48 rows
    size = {row.openalex_id: 3 * len(row.name or "") for row in journals}

    def fetch(params: dict) -> dict:
        sources = params["filter"].split(",")[0].split(":")[1].split("|")
        works = [{"source_id": source, "id": f"{source}-{n}", "title": f"work {n}", "publication_date": f"2024-03-{n % 28 + 1:02d}"} for source in sources for n in range(size[source])]
        start = 0 if params["cursor"] == "*" else int(params["cursor"])
        end = start + params["per-page"]
        return {"results": works[start:end], "next_cursor": str(end) if end < len(works) else None}

    works = read_works(spark, fetch, list(size), "2024-03-01", page=7)
    return works.groupBy("source_id").agg(F.count(F.lit(1)).alias("works"), F.max("published").alias("latest"))


@query("select paper_id, case when paper_id % 11 = 0 then null when length(title) % 2 = 0 then '1' else '0' end as answer, paper_id % 11 = 0 as failed from papers where title is not null")
def judged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records judged one by one by a rule that fails now and then: failures are kept and marked."""

    def ask(row: dict) -> str:
        if row["paper_id"] % 11 == 0:
            raise RuntimeError("no answer")
        return "1" if row["n"] % 2 == 0 else "0"

    rows = _papers(spark, sf_dir).where("title is not null").select("paper_id", F.length("title").alias("n"))
    return judge.judge(rows, ask, ["paper_id", "n"], attempts=2, wait=0.0).select("paper_id", "answer", "failed")


@query("select paper_id, length(title)::bigint as n from papers where title is not null")
def judged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records handed to a worker thirty at a time."""

    def work(rows: list[dict]) -> list[dict]:
        if len(rows) > 30:
            raise ValueError("a batch of more than thirty")
        return [{"paper_id": row["paper_id"], "n": len(row["title"])} for row in rows]

    return judge.batched(_papers(spark, sf_dir).where("title is not null").select("paper_id", "title"), work, "paper_id long, n long")


@query("""select 'KEPT' as code, count(*) as rows from papers where title is not null union all select 'REFUSED', 0 from (select 1)""")
def guarded_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is replaced by its filtered rows, and then not by nothing."""
    path = shared_path(spark, "guarded")
    _papers(spark, sf_dir).select("paper_id", "title").write.parquet(path)
    writers.guarded_overwrite(spark.read.parquet(path).where("title is not null"), path)
    try:
        writers.guarded_overwrite(spark.read.parquet(path).where("false"), path)
        refused = 1
    except writers.NothingToWrite:
        refused = 0
    kept = spark.read.parquet(path).agg(F.lit("KEPT").alias("code"), F.count(F.lit(1)).alias("rows"))
    return kept.unionByName(spark.range(1).select(F.lit("REFUSED").alias("code"), F.lit(refused).cast("long").alias("rows")))


@query("with e as (select user_id, event_type, max(event_id) as last, count(*) as n from events group by all) select user_id, event_type, last from e")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken as a stream of files, twice, and upserted by user and type: the second run changes nothing."""
    table, checkpoint = shared_path(spark, "log"), shared_path(spark, "stream")
    schema = read_table(spark, sf_dir, "events").schema
    for _ in range(2):
        stream = incremental.new_files(spark, sf_dir, schema, pathGlobFilter="events.parquet")
        incremental.run_once(stream, lambda batch, _: incremental.upsert(batch.select("user_id", "event_type", F.col("event_id").alias("last")), table, ["user_id", "event_type"], ["last"]), checkpoint)
    return spark.read.parquet(table)


@query("select event_type, count(distinct user_id) as users from events group by event_type")
def stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of user and type appended once, though the files are read again from the start."""
    table = shared_path(spark, "seen")
    schema = read_table(spark, sf_dir, "events").schema
    for run in range(2):
        stream = incremental.new_files(spark, sf_dir, schema, pathGlobFilter="events.parquet").select("user_id", "event_type")
        incremental.run_once(stream, lambda batch, _: incremental.append_unseen(batch, table, ["user_id", "event_type"]), shared_path(spark, f"again-{run}"))
    return spark.read.parquet(table).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


@query("with i as (select plan_id, sum(item_count)::bigint as n from dispatch_items where item_count > 0 and plan_id < 8 group by plan_id) select plan_id, ceil(n / 500::double)::bigint as chunks, n from i")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a few plans written in chunks of at most 500, and counted in the files."""
    plans = read_table(spark, sf_dir, "dispatch_items").where("item_count > 0 and plan_id < 8").groupBy("plan_id").agg(F.sum("item_count").alias("count"))
    parts = allocation.split_work(plans.withColumn("limit", F.lit(500)), "count", "limit")
    items = plans.select("plan_id", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("n"))
    path = shared_path(spark, "chunks")
    writers.write_chunks(items, parts, "plan_id", path)
    read = spark.read.json(path)
    return read.groupBy(F.col("plan_id").cast("long").alias("plan_id")).agg(F.countDistinct("part").alias("chunks"), F.count(F.lit(1)).alias("n"))


@query(f"""with t as (select entry_id, trim(unnest(string_split(标签, '+'))) as tag, citation_key from pool_entries where 标签 is not null and citation_key is not null), k as (select {S.quota_group('tag')} as pool, tag, citation_key, count(*) as n from t where tag <> '' group by all)
    select pool, sum(n)::bigint as rows, count(*) as kept, sum(n - 1)::bigint as dropped, count(distinct tag) as tags from k group by pool""")
def pool_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pool file: rows that came in, kept, dropped as repeats, and the tags they cover."""
    rows = read_table(spark, sf_dir, "pool_entries").where("`标签` is not null and citation_key is not null").select(F.explode(F.split("标签", r"\+")).alias("tag"), "citation_key")
    keys = rows.withColumn("tag", F.trim("tag")).where("tag <> ''").groupBy("tag", "citation_key").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy(X.quota_group("tag").alias("pool")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kept"), F.sum(F.col("n") - 1).alias("dropped"), F.countDistinct("tag").alias("tags"))


@query(f"""with k as (select {S.RANK} as rank, count(*) as n from papers group by 1) select count(*)::bigint as violations, case when count(*) = 0 then 'PASS' else 'FAIL' end as verdict from k where n < case rank when 0 then 50 when 1 then 80 else 40 end""")
def tier_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every tier reaches its target."""
    totals = _papers(spark, sf_dir).withColumn("rank", tier_rank("tier")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    return checks.verdict(reports.tier_adequacy(totals).where("status <> '✅'"))


@query("""select doc_id, 'NO_COMMENTS' as code from documents where source = 'decision_letters' and (text is null or not regexp_matches(text, '(?i)(?:reviewer|referee)\\s*(?:#?\\s*\\d+|\\(\\d+\\))')) union all
    select doc_id, 'SEEN' from documents where source = 'decision_letters' and doc_id < 0""")
def letters_without_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that no reviewer speaks in."""
    docs = _docs(spark, sf_dir).where("source = 'decision_letters'")
    comments = letters.letter_lines(docs, "doc_id", "text").where("role = 'reviewer'").select("doc_id", F.lit("R1-1").alias("comment_id"), "line_no").groupBy("doc_id", "comment_id").agg(F.count(F.lit(1)).alias("n"))
    opened = letters.lines(docs, "doc_id", "text").where(F.trim("line").rlike(letters.REVIEWER)).select("doc_id", F.lit("R1-1").alias("comment_id"))
    found = reports.letter_checks(opened.unionByName(comments.select("doc_id", "comment_id")).distinct(), docs, "doc_id")
    return found.select(F.col("key").cast("long").alias("doc_id"), "code")


@query("select count(*) filter (text is not null and not contains(text, '## 引用池')) as without_block, count(*) filter (text is null) as without_text, count(*) as files from documents")
def block_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a pool block, and without any text."""
    return _docs(spark, sf_dir).agg(F.count_if(F.col("text").isNotNull() & ~F.contains("text", F.lit("## 引用池"))).alias("without_block"), F.count_if(F.col("text").isNull()).alias("without_text"), F.count(F.lit(1)).alias("files"))


@query("select doc_id, case when doc_id % 3 = 0 then 'would change' else 'unchanged' end as preview from documents where text is not null and not contains(text, '## 引用池')")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert of blocks would change; nothing is written."""
    files = _docs(spark, sf_dir).where("text is not null and not contains(text, '## 引用池')").select(F.col("doc_id").alias("file"), "text")
    edited = writers.upsert_blocks(files, "## 引用池", files.where("file % 3 = 0").select("file", F.lit("## 引用池\nnew").alias("block")))
    return edited.select(F.col("file").alias("doc_id"), F.when(F.col("changed"), "would change").otherwise("unchanged").alias("preview"))

"""Queries of the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.operators import audits, checks, reports
from folioscale.operators import search as search_dsl
from folioscale.plans import sqltext as S
from folioscale.plans.registry import Registry
from folioscale.runtime import read_table

registry = Registry()
query = registry.query


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "papers")


_WORD_CHARS = "[^\\p{L}\\p{N}_\\s]"


@query(f"with s as (select id, {S.strip(chr(34) + 'n' + chr(34))} as t from (select id, regexp_replace(regexp_replace(coalesce(name, ''), '[（(][^）)]*[）)]', '', 'g'), '[/\\\\:*?\"<>|]', '_', 'g') as n from directions)) select id, coalesce(nullif({S.strip('left(t, 10)')}, ''), 'unknown') as short from s")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "directions").select("id", X.short_name("name").alias("short"))


@query(
    f"""with l as (select paper_id, string_split_regex({S.strip(f"regexp_replace({S.strip('replace(lower(title), chr(38), chr(97) || chr(110) || chr(100))')}, '^\\d+(\\.\\d+)*\\.?\\s*', '')")}, '\\s+') as ws from papers where title is not null)
    select paper_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(ws, lambda w: w not in ('a', 'an', 'the')), ' '), '{_WORD_CHARS}', '', 'g'), '\\s+', ' ', 'g')) as form from l"""
)
def section_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).where("title is not null").select("paper_id", X.section_form("title").alias("form"))


_SLUG = "a an and are as at based be been between by for from in into is it its not of on or that the their these this those through to toward towards among but using via was were with"


@query(f"select paper_id, left(array_to_string(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z]+'), lambda w: not list_contains(string_split('{_SLUG}', ' '), w))[1:4], '_'), 40) as slug from papers")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).select("paper_id", X.slug("title").alias("slug"))


@query("""select paper_id, 'Vol' || case when paper_id % 3 = 0 then 'unknown' else (paper_id % 90)::varchar end || '_' || case when paper_id % 2 = 0 then 'March_' || coalesce(year, 2001)::varchar else '2026' end as label from papers""")
def volume_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings made of the ids and years of records."""
    number = F.when(F.col("paper_id") % 3 == 0, "Issue 4").otherwise(F.concat(F.when(F.col("paper_id") % 2 == 0, "Volume ").otherwise("vol. "), (F.col("paper_id") % 90).cast("string")))
    heading = F.concat(number, F.lit(", "), F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit("March "), F.coalesce("year", F.lit(2001)).cast("string"))).otherwise("in press"))
    return _papers(spark, sf_dir).select("paper_id", X.volume_label(heading).alias("label"))


@query(f"select paper_id, left({S.strip('reason')}, 120) as part from papers where reason is not null and not contains(reason, '差异') and not contains(reason, '区别')")
def difference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons behind a marker of difference, before which other text stands."""
    rows = _papers(spark, sf_dir).where("reason is not null and not contains(reason, '差异') and not contains(reason, '区别')")
    marked = F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit("前文。差异："), "reason")).otherwise(F.col("reason"))
    return rows.select("paper_id", X.difference_part(marked).alias("part"))


@query(f"""with t as (select paper_id, {S.strip('title')} as t from papers where title is not null)
    select paper_id, case when length(t) <= 10 then t else list_filter(regexp_split_to_array(t, '[，。：；！？,.:;!?—-]+'), lambda p: length(p) between 1 and 10)[1] end as short from t""")
def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).where("title is not null").select("paper_id", X.short_title("title").alias("short"))


@query("select paper_id, case when paper_id % 5 = 0 then null else '10.5555/' || paper_id end as doi from papers")
def dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs written as links, with a prefix, with blanks, or not at all."""
    bare = F.concat(F.lit("10.5555/"), F.col("paper_id").cast("string"))
    kind = F.col("paper_id") % 5
    written = F.when(kind == 1, F.concat(F.lit("https://doi.org/"), bare)).when(kind == 2, F.concat(F.lit(" DOI: "), bare, F.lit("  "))).when(kind == 3, F.concat(F.lit("http://dx.doi.org/"), bare)).when(kind == 4, bare).otherwise("  ")
    return _papers(spark, sf_dir).select("paper_id", X.doi(written).alias("doi"))


@query("select item_id, regexp_replace(regexp_replace(source_file, '\\.[A-Za-z]+$', ''), '_llm$', '') as stem from dispatch_items where source_file is not null and not regexp_matches(source_file, '_zone|_llm')")
def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files with the suffixes that screening adds."""
    rows = read_table(spark, sf_dir, "dispatch_items").where(F.col("source_file").isNotNull() & ~F.col("source_file").rlike("_zone|_llm"))
    suffix = F.when(F.col("item_id") % 3 == 0, "_zone2_llm.ris").when(F.col("item_id") % 3 == 1, "_llm.ris").otherwise(".ris")
    return rows.select("item_id", X.stem(F.concat(F.regexp_replace("source_file", r"\.[A-Za-z]+$", ""), suffix)).alias("stem"))


@query("select doc_id, case doc_id % 4 when 0 then '改写' when 1 then '新增' when 2 then '重组' end as mode from documents")
def content_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode an outline names, else the comment of a manuscript; an unknown one stops the work."""
    kind = F.col("doc_id") % 4
    outline = F.when(kind == 0, "模式：改写").when(kind == 1, "mode = 新增").when(kind == 3, "模式：扩写")
    comment = F.when(kind == 0, "% 模式: 展开").when(kind == 2, "% mode: 重组")
    return read_table(spark, sf_dir, "documents").select("doc_id", X.content_mode(outline, comment).alias("mode"))


@query("select paper_id, paper_id % 7 not in (1, 3) as kept from papers")
def answers_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a screening model in the forms they take."""
    forms = ["1. 相关", "0：不相关", "1", "该文与主题无关", "相关，标注1", "", "unclear"]
    answer = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("paper_id") % 7 + 1).cast("int"))
    return _papers(spark, sf_dir).select("paper_id", X.answer_kept(answer).alias("kept"))


@query("""with k as (select unnest(['博弈', '网络', '韧性', '平台', '别的']) as keyword), t as (select keyword, unnest(case keyword when '博弈' then ['game theory', 'mechanism design', 'contract', 'incentive'] when '网络' then ['network', 'graph', 'centrality', 'community'] when '韧性' then ['resilience', 'disruption', 'robustness'] when '平台' then ['platform', 'two-sided market', 'matching'] else [keyword] end) as term from k)
    select keyword, term, (select count(*) from papers where contains(lower(title), lower(term))) as papers from t""")
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search words with the terms they stand for and the records that have each."""
    words = spark.createDataFrame([(w,) for w in ("博弈", "网络", "韧性", "平台", "别的")], "keyword string")
    terms = reports.expand_keywords(words, "keyword")
    # a dozen terms, one scan of the records
    wanted = [row.term for row in terms.select("term").distinct().collect()]
    counts = _papers(spark, sf_dir).agg(*[F.count_if(F.contains(F.lower("title"), F.lit(term.lower()))).alias(term) for term in wanted])
    by_term = counts.select(F.explode(F.array(*[F.struct(F.lit(term).alias("term"), F.col(f"`{term}`").alias("papers")) for term in wanted])).alias("x")).select("x.*")
    return terms.join(F.broadcast(by_term), "term").select("keyword", "term", "papers")


@query("with s as (select paper_id, direction, (relevance % 6)::int as n, (relevance % 5)::int as c, (paper_id % 6)::int as f from papers where relevance is not null and direction is not null) select paper_id, direction, 2 * n + 2 * c + f as score, (2 * n + 2 * c + 1.5::double * f + n + 1.5::double * c) as review, rank() over (partition by direction order by 2 * n + 2 * c + f desc)::int as rank from s")
def idea_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted scores of records taken as ideas, ranked by direction, all kept."""
    rows = _papers(spark, sf_dir).where("relevance is not null and direction is not null")
    n, c, f = (F.col("relevance") % 6).cast("int"), (F.col("relevance") % 5).cast("int"), (F.col("paper_id") % 6).cast("int")
    scored = rows.select("paper_id", "direction", X.idea_score(n, c, f).alias("score"), X.review_score(n, c, f, n, c).alias("review"))
    return reports.journal_leaders(scored, "direction", "score").select("paper_id", "direction", "score", "review", "rank")


@query("select paper_id, coalesce(regexp_matches(case when paper_id % 3 = 0 then upper(journal) else journal end, '^[A-Z0-9 :&-]+$') and regexp_matches(upper(journal), '[A-Z]{2}') and regexp_matches(case when paper_id % 3 = 0 then upper(journal) else journal end, '[A-Z]{2}'), false) as capitals from papers")
def journal_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals in capitals only; every third is made so."""
    return _papers(spark, sf_dir).select("paper_id", reports.all_capitals(F.when(F.col("paper_id") % 3 == 0, F.upper("journal")).otherwise(F.col("journal"))).alias("capitals"))


@query("select paper_id, list_filter([case when length(title) > 10 then 'api title' end, case when length(title) > 22 then 'title' end, case when length(reason) > 15 then 'digest' end], lambda x: x is not null) as gates from papers")
def title_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).select("paper_id", reports.title_gates(F.col("title"), F.col("reason")).alias("gates"))


@query(f"""select source_id, {S.strip("split_part(regexp_replace(string_split(coalesce(author_full, ''), ' and ')[1], '[{{}}]', '', 'g'), ',', 1)")} as surname, coalesce(year, 0) as year, regexp_replace(coalesce(title, ''), '[{{}}]', '', 'g') as title, coalesce(nullif({S.strip('journal')}, ''), 'Proceedings') as journal from source_papers""")
def bib_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of bibliography records as citations show them; where the journal lacks, a book is named."""
    fields = reports.bib_fields(F.col("author_full"), F.col("year").cast("string"), F.col("title"), F.col("journal"), F.lit("Proceedings"))
    return read_table(spark, sf_dir, "source_papers").select("source_id", *[column.alias(name) for name, column in fields.items()])


@query("""select paper_id, case when paper_id % 7 = 0 then null when paper_id % 7 in (1, 2) then coalesce(year, 1999)::varchar when paper_id % 7 = 3 then '2026' when paper_id % 7 = 4 then (2000 + paper_id % 50)::varchar when paper_id % 7 = 5 then (1990 + paper_id % 9)::varchar end as year from papers""")
def record_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of export records from the date, the issue date, two forms of links, or the DOI; beyond 2100 there is none."""
    kind, year = F.col("paper_id") % 7, F.coalesce("year", F.lit(1999)).cast("string")
    date, issued = F.when(kind == 1, year), F.when(kind == 2, F.concat(year, F.lit("-05-01")))
    link = F.when(kind == 3, "http://x/doi/10.2.20260402.1.2").when(kind == 4, F.concat(F.lit("http://x/"), (2000 + F.col("paper_id") % 50).cast("string"), F.lit("12.3")))
    doi = F.when(kind == 5, F.concat(F.lit("10.1/j."), (1990 + F.col("paper_id") % 9).cast("string"), F.lit("01.7"))).when(kind == 6, "10.1/j.210501.7")
    return _papers(spark, sf_dir).select("paper_id", X.record_year(date, issued, link, doi).alias("year"))


@query("select event_id, event_id % 3 <> 2 as has_dash, (event_id % 90)::varchar as first, case when event_id % 3 = 2 then '' else (event_id % 90 + 7)::varchar end as last, list_filter([trim(event_type), case when event_id % 2 = 0 then 'b' end], lambda x: x is not null) as keywords from events")
def page_and_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges with any dash, and keywords between semicolons of either width."""
    kind = F.col("event_id") % 3
    first, last = (F.col("event_id") % 90).cast("string"), (F.col("event_id") % 90 + 7).cast("string")
    page = X.pages(F.when(kind == 0, F.concat(first, F.lit(" - "), last)).when(kind == 1, F.concat(first, F.lit("–"), last)).otherwise(first))
    words = X.keywords(F.concat(F.col("event_type"), F.lit(" ；; "), F.when(F.col("event_id") % 2 == 0, "b;").otherwise("")))
    return read_table(spark, sf_dir, "events").select("event_id", (page["last"] != "").alias("has_dash"), page["first"].alias("first"), page["last"].alias("last"), words.alias("keywords"))


@query("select paper_id, replace(replace(replace(replace(title, '&', '\\&'), '%', '\\%'), '#', '\\#'), '_', '\\_') as escaped, regexp_replace(replace(title, '|', '/'), '\\r?\\n', ' ', 'g') as cell from papers where title is not null")
def escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).where("title is not null").select("paper_id", X.bibtex_escape("title").alias("escaped"), X.table_cell("title").alias("cell"))


@query("select paper_id, coalesce(date_diff('day', screened_at::date, loaded_at::date) <= 30, false) as fresh, coalesce(epoch(loaded_at)::bigint - epoch(screened_at)::bigint <= 86400 and abs(length(title) / nullif(length(reason), 0)::double - 1) <= 0.2, false) as cached from papers")
def fresh_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a screening was at most a month old when loaded, and a cache of a day whose words changed little."""
    words_now, words_then = F.length("title"), F.nullif(F.length("reason"), F.lit(0))
    return _papers(spark, sf_dir).select("paper_id", reports.fresh(F.col("screened_at"), F.col("loaded_at"), 30).alias("fresh"), reports.fresh_cache(F.col("screened_at"), F.col("loaded_at"), words_then, words_now).alias("cached"))


@query("select doc_id, case when coalesce(n_chars, 0) < 100 then 'stop' when doc_id % 130 > 100 then 'reject' when doc_id % 130 > 60 then 'warn' else 'ok' end as gate from documents")
def size_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", reports.size_gate(F.col("n_chars"), F.col("doc_id") % 130).alias("gate"))


@query("select doc_id, abs(n_chars / 1500::double - 1) <= 0.1 as within_tenth, abs(n_chars / 1500::double - 1) <= 0.15 as within_draft from documents")
def word_budget_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of documents against a plan of 1,500 characters."""
    return read_table(spark, sf_dir, "documents").select("doc_id", audits.within_budget(F.col("n_chars"), F.lit(1500), 0.1).alias("within_tenth"), audits.within_budget(F.col("n_chars"), F.lit(1500), 0.15).alias("within_draft"))


@query("""with s as (select item_id, case item_id % 4 when 0 then 'elsevier' when 1 then 'Sage' when 2 then 'wiley' else 'unknown' end as publisher, case when item_id % 3 = 0 then ['coverletter'] when item_id % 3 = 1 then ['titlepage', 'highlights'] end as files from dispatch_items)
    select item_id, list_filter(case lower(publisher) when 'elsevier' then ['coverletter', 'declaration', 'highlights', 'titlepage'] when 'sage' then ['coverletter'] when 'wiley' then ['coverletter', 'titlepage'] else [] end, lambda f: not list_contains(coalesce(files, []), f)) as missing from s""")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that submissions lack; work items stand for submissions."""
    kind, held = F.col("item_id") % 4, F.col("item_id") % 3
    rows = read_table(spark, sf_dir, "dispatch_items").select("item_id", F.when(kind == 0, "elsevier").when(kind == 1, "Sage").when(kind == 2, "wiley").otherwise("unknown").alias("publisher"), F.when(held == 0, F.array(F.lit("coverletter"))).when(held == 1, F.array(F.lit("titlepage"), F.lit("highlights"))).alias("files"))
    return audits.missing_files(rows, "publisher", "files").select("item_id", "missing")


@query(r"""with t as (select paper_id, ' ' || regexp_replace(replace(replace(lower(title), 'construction industry', ' '), 'building information', ' '), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' as x from papers where title is not null)
    select paper_id, list_filter([case when regexp_matches(x, ' construction ') then 'construction' end, case when regexp_matches(x, ' building[\p{L}\p{N}]* ') then 'building*' end], lambda w: w is not null) as terms from t where regexp_matches(x, ' construction | building[\p{L}\p{N}]* ')""")
def ambiguous_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles taken as search texts, with the terms that stand outside a phrase that makes them clear."""
    terms = search_dsl.ambiguous_terms(F.col("title"), {"construction": ("construction industry",), "building*": ("building information",)})
    return _papers(spark, sf_dir).where("title is not null").select("paper_id", terms.alias("terms")).where(F.size("terms") > 0)


@query("select doc_id, length(text) - length(replace(text, '{', '')) = length(text) - length(replace(text, '}', '')) as equal_numbers from documents where text is not null and not regexp_matches(regexp_replace(text, '[^{}]', '', 'g'), '^\\}|\\}\\}\\}')")
def brace_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether braces balance, in texts where none closes before one opens."""
    rows = read_table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.regexp_replace("text", "[^{}]", "").rlike(r"^\}|\}\}\}"))
    return rows.select("doc_id", checks.braces(F.col("text")).alias("equal_numbers"))

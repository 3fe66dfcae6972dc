"""Queries of the file formats: tables are written as RIS, EndNote, BibTeX, Markdown, JSON and CSV, read back and compared with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.operators import letters, reports
from folioscale.plans import sqltext as S
from folioscale.plans.registry import Registry
from folioscale.runtime import cut_lineage, read_table, shared_path
from folioscale.sinks import writers
from folioscale.sources import records, tables

registry = Registry()
query = registry.query


_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _flat(column: str) -> Column:
    """A value on one line, blanks of any width collapsed; null if empty."""
    return F.nullif(F.trim(F.regexp_replace(column, _BLANKS, " ")), F.lit(""))


def _flat_sql(column: str) -> str:
    return f"nullif(trim(regexp_replace({column}, '{_BLANKS}', ' ', 'g'), ' '), '')"


def _map(**tags: Column) -> Column:
    """Fields of a record: tags with the values that are not null."""
    pairs = F.array(*[F.struct(F.lit(tag).alias("k"), F.array_compact(values if isinstance(values, tuple) is False else F.array(*values)).alias("v")) for tag, values in tags.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["v"]) > 0))


def _written(spark: SparkSession, texts: DataFrame, name: str) -> str:
    """The path of text files that hold the column `text`, in the session's shared folder."""
    path = shared_path(spark, name)
    texts.select("text").write.text(path)
    return path


def _ris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened records as RIS, written and read back."""
    rows = read_table(spark, sf_dir, "papers").where("title is not null")
    fields = _map(
        TY=F.array(F.when(F.col("paper_id") % 5 == 0, "CONF").when(F.col("paper_id") % 5 == 1, "BOOK").when(F.col("paper_id") % 5 != 2, "JOUR")), ID=F.array(F.col("paper_id").cast("string")), TI=F.array(_flat("title")), AU=F.array(_flat("first_author"), F.lit("Second, B.")), PY=F.array(F.concat(F.col("year").cast("string"), F.lit("/01"))),
        T2=F.array(F.when(F.col("paper_id") % 2 == 0, _flat("journal"))), JO=F.array(F.when(F.col("paper_id") % 2 == 1, _flat("journal"))), SN=F.array(F.lit(" 1234-567x"), F.lit("2345-6789")), KW=F.array(F.lit("a b"), F.lit("c")), AB=F.array(_flat("reason")), DO=F.array(F.concat(F.lit("https://doi.org/10.5/"), F.col("paper_id").cast("string"))),
    )
    return records.read_ris(spark, _written(spark, rows.select(writers.ris_text(fields).alias("text")), "ris"))


@query(
    f"""select paper_id, case paper_id % 5 when 0 then 'CONF' when 1 then 'BOOK' else 'JOUR' end as kind, {_flat_sql('title')} as title, {S.lead_author(f"coalesce({_flat_sql('first_author')}, 'Second, B.')")} as surname, year, {_flat_sql('journal')} as journal, 2::int as issns, '10.5/' || paper_id as doi, {_flat_sql('reason')} as abstract, 2::int as keywords
    from papers where title is not null"""
)
def ris_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _ris(spark, sf_dir)
    ids = read.select("file", "ordinal", records.value("ID").cast("long").alias("paper_id"), records.value("TY").alias("kind"))
    shown = records.screening_fields(read).join(ids, ["file", "ordinal"])
    return shown.select("paper_id", "kind", "title", "surname", "year", "journal", F.size("issns").alias("issns"), "doi", "abstract", F.size("keywords").alias("keywords"))


@query("select direction, source_type = 'cnki' as is_cnki, count(*) as n from papers where direction is not null and source_type is not null group by all")
def ris_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the number and the suffix of the file they stand in."""
    rows = read_table(spark, sf_dir, "papers").where("direction is not null and source_type is not null")
    return records.count_by_direction(rows.select(F.concat(F.lit("/data/"), "direction", F.when(F.col("paper_id") % 2 == 0, "_").otherwise("-"), F.lit("topic"), F.when(F.col("source_type") == "cnki", "_cnki").otherwise(""), F.lit(".ris")).alias("file")))


@query("select 'summary' as source, sum(relevance)::bigint as total from papers union all select 'records', count(*) from papers")
def raw_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of a summary, and the number of records where the summary says nothing."""
    rows = read_table(spark, sf_dir, "papers")
    told = reports.raw_total(rows, "relevance", rows).withColumn("source", F.lit("summary"))
    return told.unionByName(reports.raw_total(rows.select(F.lit(0).alias("relevance")), "relevance", rows).withColumn("source", F.lit("records"))).select("source", "total")


@query("with d as (select doc_id, len(regexp_extract_all(regexp_replace(text, '\\r', '', 'g'), '(?m)^[A-Z][A-Z0-9]  -')) as tags from documents where text is not null and (source like 'wos_export%' or source = 'cnki_export')) select doc_id, tags::bigint as tags from d where tags > 0")
def export_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged lines of the records that stand in export texts."""
    rows = records.records_of(read_table(spark, sf_dir, "documents").where("source like 'wos_export%' or source = 'cnki_export'"), "doc_id", "text", "ris")
    return rows.groupBy("doc_id").agg(F.sum(F.aggregate(F.map_values("fields"), F.lit(0).cast("long"), lambda n, v: n + F.size(v))).alias("tags"))


def _enw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened records as EndNote exports, written and read back."""
    rows = read_table(spark, sf_dir, "papers").where("title is not null")
    kind = F.col("paper_id") % 4
    line = lambda tag, value: F.concat(F.lit(f"{tag} "), value)
    year = F.col("year").cast("string")
    text = F.array_join(
        F.array_compact(
            F.array(
                line("%0", F.when(kind == 0, "Newspaper Article").when(kind == 1, "Thesis").when(kind == 2, "Odd Kind").otherwise("Journal Article")), line("%A", _flat("first_author")), F.lit("%A Second, B."), line("%T", F.concat(_flat("title"), F.lit("\n on a second line"))), line("%J", _flat("journal")),
                F.when(F.col("paper_id") % 3 == 0, line("%D", year)).when(F.col("paper_id") % 3 == 1, line("%8", F.concat(year, F.lit("-05-01")))), F.lit("%K a；b; c"), line("%P", F.when(kind == 1, "7").otherwise("1–15")), line("%M", F.col("paper_id").cast("string")),
            )
        ),
        "\n",
    )
    return records.read_enw(spark, _written(spark, rows.select(F.concat(text, F.lit("\n")).alias("text")), "enw"))


@query(
    f"""select paper_id, case paper_id % 4 when 1 then 'THES' when 2 then 'GEN' else 'JOUR' end as kind, {_flat_sql('title')} || ' on a second line' as title, case when {_flat_sql('first_author')} is null then 1 else 2 end::int as authors, case when paper_id % 3 <> 2 then year::varchar end as year,
    {_flat_sql('journal')} as journal, 3::int as keywords, case when paper_id % 4 = 1 then '7' else '1' end as first, case when paper_id % 4 <> 1 then '15' end as last from papers where title is not null and {_flat_sql('title')} is not null and paper_id % 4 <> 0"""
)
def enw_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EndNote exports turned into RIS without newspapers, and the RIS read."""
    done = writers.enw_to_ris(_enw(spark, sf_dir), skip_newspapers=True).where(records.value("%T").isNotNull() & (records.value("%T") != "on a second line"))
    read = done.select(records.value("%M").cast("long").alias("paper_id"), records.ris_fields("ris").alias("f"))
    get = lambda tag: records.value(tag, "f")
    return read.select("paper_id", get("TY").alias("kind"), get("TI").alias("title"), F.size(records.values("AU", "f")).alias("authors"), get("PY").alias("year"), get("T2").alias("journal"), F.size(records.values("KW", "f")).alias("keywords"), get("SP").alias("first"), get("EP").alias("last"))


@query("""with p as (select *, paper_id % 4 <> 0 as done, case when paper_id % 3 <> 2 then year end as y from papers where title is not null)
    select count(*) as records, count(*) filter (done) as converted, count(*) filter (not done) as skipped, count(*) filter (done and y is null) as no_year, count(*) filter (done and y is not null and paper_id % 3 = 1) as found_year from p""")
def enw_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(_enw(spark, sf_dir))
    return writers.conversion_counts(writers.enw_to_ris(rows, skip_newspapers=True), rows)


@query("select case paper_id % 4 when 0 then 'Newspaper Article' when 1 then 'Thesis' when 2 then 'Odd Kind' else 'Journal Article' end as kind, count(*) as n from papers where title is not null group by 1")
def enw_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enw(spark, sf_dir).groupBy(records.value("%0").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _escaped(column: str) -> str:
    return f"replace(replace(replace(replace({column}, '&', '\\&'), '%', '\\%'), '#', '\\#'), '_', '\\_')"


def _bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography records as BibTeX text (source_id, text); braces in values are dropped, since they may not balance."""
    plain = lambda column: F.regexp_replace(_flat(column), '[{}"]', "")
    rows = read_table(spark, sf_dir, "source_papers")
    fields = _map(TY=F.array(F.when(F.col("source_id") % 3 == 0, "CONF").when(F.col("source_id") % 3 == 1, "THES")), AU=F.array(F.nullif(plain("author_full"), F.lit(""))), TI=F.array(F.nullif(plain("title"), F.lit(""))), T2=F.array(F.nullif(plain("journal"), F.lit(""))), PY=F.array(F.col("year").cast("string")), SP=F.array(F.lit("3")), EP=F.array(F.lit("9")), N1=F.array(F.lit("LA:zh")))
    key = F.concat(F.lit("s"), "source_id")
    full = writers.ris_to_bibtex(key, fields, F.lit("Nobody"), F.lit("Untitled"), F.lit(""), F.lit(1900))
    stub = writers.stub_bibtex(key, F.coalesce(F.nullif(plain("author_full"), F.lit("")), F.lit("Nobody")), F.coalesce(F.nullif(plain("title"), F.lit("")), F.lit("Untitled")), F.coalesce(plain("journal"), F.lit("")), F.coalesce("year", F.lit(1900)))
    return rows.select("source_id", F.when(F.col("source_id") % 4 == 0, stub).otherwise(full).alias("text"))


def _plain_sql(column: str) -> str:
    return f"nullif(regexp_replace({_flat_sql(column)}, '[{{}}\"]', '', 'g'), '')"


@query(
    f"""with s as (select source_id, source_id % 4 = 0 as stub, coalesce({_escaped(_plain_sql('author_full'))}, 'Nobody') as author, coalesce({_escaped(_plain_sql('title'))}, 'Untitled') as title, {_escaped(_plain_sql('journal'))} as journal, coalesce(year, 1900)::varchar as year from source_papers)
    select 's' || source_id as key, case when stub or source_id % 3 = 2 then 'article' when source_id % 3 = 0 then 'inproceedings' else 'phdthesis' end as type, trim(regexp_replace(author, '\\s+', ' ', 'g'), ' ') as author, trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ') as title, trim(regexp_replace(journal, '\\s+', ' ', 'g'), ' ') as venue, year, case when not stub then '3--9' end as pages, case when not stub then 'chinese' end as language, stub as open from s"""
)
def bibtex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full entries and stubs, written as BibTeX and read back."""
    read = records.read_bibtex(spark, _written(spark, _bib(spark, sf_dir), "bib"), last_wins=False)
    get = records.value
    title = F.regexp_replace(get("title"), r"^\{|\}$", "")
    return read.select(get("key").alias("key"), get("type").alias("type"), get("author").alias("author"), F.trim(title).alias("title"), F.coalesce(get("journal"), get("booktitle")).alias("venue"), get("year").alias("year"), get("pages").alias("pages"), get("language").alias("language"), F.coalesce(get("note").startswith("TODO"), F.lit(False)).alias("open"))


@query("select 'k' || source_id % 50 as key, max(source_id)::bigint as last, count(*) as held from source_papers group by 1")
def bibtex_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty keys used again and again in one text: the last entry of a key wins, all of them are counted."""
    entry = F.concat(F.lit("@misc{k"), (F.col("source_id") % 50).cast("string"), F.lit(", title = {"), F.col("source_id").cast("string"), F.lit("}}"))
    # one text for each key, so no text holds more than its key's entries
    texts = read_table(spark, sf_dir, "source_papers").groupBy((F.col("source_id") % 50).alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("source_id", entry.alias("e"))))["e"], "\n").alias("text"))
    rows = records.records_of(texts, "doc_id", "text", "bibtex")
    return rows.groupBy(records.value("key").alias("key")).agg(F.max_by(records.value("title").cast("long"), "n").alias("last"), F.count(F.lit(1)).alias("held"))


@query("select source_id, '@article{p' || source_id || ', title={x, y}}' as entry from source_papers")
def rekeyed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries taken over under a new key."""
    old = F.concat(F.lit("old"), "source_id")
    raw = F.concat(F.lit("@article{"), old, F.lit(", title={x, y}}"))
    return read_table(spark, sf_dir, "source_papers").select("source_id", writers.rekeyed(raw, old, F.concat(F.lit("p"), "source_id")).alias("entry"))


@query("""with e as (select source_id, case when source_id % 3 = 0 then null else coalesce(author_full, '') end as author, coalesce(title, '') as title, coalesce(year::varchar, '') as year from source_papers)
    select key, code from (select 's' || source_id as key, unnest([case when trim(coalesce(author, '')) = '' then 'MISSING_AUTHOR' end, case when trim(title) = '' then 'MISSING_TITLE' end, case when year = '' then 'MISSING_YEAR' end, 'NO_DOI', case when source_id % 5 = 0 then 'BRACES' end]) as code from e) where code is not null
    union all select 's' || source_id, 'DUPLICATE_KEY' from e where source_id % 7 = 0""")
def bib_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without an author, with open braces, or held twice."""
    rows = read_table(spark, sf_dir, "source_papers")
    fields = _map(author=F.array(F.when(F.col("source_id") % 3 != 0, F.col("author_full"))), title=F.array("title"), year=F.array(F.col("year").cast("string")))
    entries = rows.select(F.concat(F.lit("s"), "source_id").alias("key"), fields.alias("fields"), F.when(F.col("source_id") % 5 == 0, "@a{x, t={y}").otherwise("@a{x, t={y}}").alias("raw"), "source_id")
    again = entries.where("source_id % 7 = 0")
    found = reports.bib_checks(entries.unionByName(again).drop("source_id"))
    return found.distinct()


@query("select distinct source_cite_key as key from source_papers where source_cite_key in (select source_cite_key from source_papers where source_id % 3 <> 0) and source_cite_key not in (select source_cite_key from source_papers where source_id % 2 = 0 and source_cite_key is not null)")
def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the bibliography that two thirds of it name and the even half lacks."""
    master = read_table(spark, sf_dir, "source_papers").select("source_id", F.col("source_cite_key").alias("key")).where("key is not null")
    return writers.new_entries(master.where("source_id % 3 <> 0"), master.where("source_id % 2 = 0"), master.select("key").distinct())


# Markdown reports: the ten leading records of each direction and tier


def _leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.functions.tiers import tier_rank

    rows = read_table(spark, sf_dir, "papers").where("direction is not null and year between 1000 and 9999").select("direction", "paper_id", "title", "first_author", "journal", "year", "reason", tier_rank("tier").alias("rank"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("direction", "rank").orderBy("paper_id"))).where("n <= 10")


_LEADING = f"lead as (select * from (select direction, paper_id, title, first_author, journal, year, reason, {S.RANK} as rank, row_number() over (partition by direction, {S.RANK} order by paper_id) as n from papers where direction is not null and year between 1000 and 9999) where n <= 10)"
_TIER_HEADS = {0: "## 一、核心文献", 1: "## Important", 2: "## 备选文献 (Backup)"}
_TAG_CELLS = ("BG+LR", "`GAP-RQ1`、METHOD-x", "—", "nonsense; DISC")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line, n, rank, paper_id): a report for each direction, tables of seven columns under tier headings."""
    rows = _leading(spark, sf_dir)
    cell = lambda column: F.coalesce(F.replace(F.regexp_replace(column, r"\s+", " "), F.lit("|"), F.lit("\\|")), F.lit(""))
    tags = F.element_at(F.array(*[F.lit(x) for x in _TAG_CELLS]), (F.col("paper_id") % 4 + 1).cast("int"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("n").cast("string"), cell("first_author"), cell("title"), F.col("year").cast("string"), cell("journal"), tags, cell("reason")), F.lit(" |"))
    body = rows.select("direction", "rank", (F.col("n") + 2).alias("at"), "n", "paper_id", line.alias("line"))
    heads = rows.select("direction", "rank").distinct()
    head = F.when(F.col("rank") == 0, _TIER_HEADS[0]).when(F.col("rank") == 1, _TIER_HEADS[1]).otherwise(_TIER_HEADS[2])
    none = [F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("paper_id")]
    tops = heads.select("direction", "rank", F.lit(0).alias("at"), *none, head.alias("line")).unionByName(heads.select("direction", "rank", F.lit(1).alias("at"), *none, F.lit("| # | 作者 | 标题 | 年份 | 期刊 | 标签 | 理由 |").alias("line")))
    tops = tops.unionByName(heads.select("direction", "rank", F.lit(2).alias("at"), *none, F.lit("|---|---|---|---|---|---|---|").alias("line")))
    meta = heads.select("direction").distinct().select("direction", F.lit(-1).alias("rank"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("at"), *none).withColumn("line", F.when(F.col("at") == 0, "# 报告").when(F.col("at") == 1, F.concat(F.lit("> direction: "), "direction")).otherwise("> source_type: wos"))
    ends = heads.select("direction").distinct().select("direction", F.lit(9).alias("rank"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("at"), *none).withColumn("line", F.when(F.col("at") == 0, "## 小结").otherwise("| 4 | no | row | 2020 | of | a | tier |"))
    lines = body.unionByName(tops).unionByName(meta).unionByName(ends)
    return lines.select(F.concat(F.lit("d"), "direction", F.lit("_batch1.md")).alias("file"), (F.col("rank") * 100 + F.col("at") + 200).alias("line_no"), "line", "n", "rank", "paper_id")


_CELL = "regexp_replace({}, '\\s+', ' ', 'g')"


@query(
    f"""with {_LEADING} select 'd' || direction || '_batch1.md' as file, case rank when 0 then 'core' when 1 then 'important' else 'backup' end as tier, n::int as n, trim(coalesce({_CELL.format('first_author')}, ''), ' ') as author, trim(coalesce({_CELL.format('title')}, ''), ' ') as title, year, trim(coalesce({_CELL.format('journal')}, ''), ' ') as journal,
    case paper_id % 4 when 0 then ['BG', 'LR'] when 1 then ['GAP-RQ1', 'METHOD-x'] when 2 then [] else ['DISC'] end as tags, trim(coalesce({_CELL.format('reason')}, ''), ' ') as reason from lead"""
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as Markdown and their tables read back; rows after the last tier are none."""
    return tables.paper_tables(_report(spark, sf_dir)).select("file", "tier", "n", "author", "title", "year", "journal", "tags", "reason")


@query(f"with {_LEADING} select 'd' || direction || '_batch1.md' as file, case rank when 0 then 'core' when 1 then 'important' else 'backup' end as tier, count(*) as n from lead group by all union all select distinct 'd' || direction || '_batch1.md', null, 1 from lead")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.row_counts(_report(spark, sf_dir))


@query(f"with {_LEADING} select distinct 'd' || direction || '_batch1.md' as file, direction::int as direction, null::int as total, 'wos' as source_type from lead")
def batch_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.batch_metadata(_report(spark, sf_dir)).select("file", "direction", "total", "source_type")


@query(f"with {_LEADING} select 'd' || direction || '_batch1.md' as file, count(*)::bigint + 1 as cells_rows, sum(case when paper_id % 4 = 0 then 1 else 0 end)::bigint as two_tags from lead group by 1")
def pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables of each report that stand after a separator, and those with the first tag cell (the last row has no separator of its own)."""
    rows = tables.pool_table(_report(spark, sf_dir).where("rank <> 9 or line not like '##%'"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("cells_rows"), F.count_if(F.get("cells", F.lit(5)) == "BG+LR").alias("two_tags"))


@query(f"""with {_LEADING} select 'd' || direction || '_batch1.md' as file, n::int as n, rank::int as rank, n % 3 = 0 as missing, case when n % 3 <> 0 then 'T' || n end as tag from lead""")
def inserted_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag column put into the reports; every third row has no tag and is marked."""
    lines = cut_lineage(_report(spark, sf_dir).where("rank between 0 and 2"))
    named = tables.with_tier(lines.drop("n"))
    tags = tables.with_tier(lines).where("n is not null and n % 3 <> 0").select("file", "tier", "n", F.array(F.concat(F.lit("T"), "n")).alias("tags"))
    edited = writers.insert_column(named.select("file", "line_no", "line", "tier"), "新标签", tags).join(lines.select("file", "line_no", "n", "rank"), ["file", "line_no"]).where("n is not null")
    own = F.get(tables.cells(F.col("line")), F.size(tables.cells(F.col("line"))) - 2)
    return edited.select("file", "n", F.col("rank").cast("int").alias("rank"), "missing", F.when(~F.col("missing"), own).alias("tag"))


@query("""with l as (select direction_id as file, n, k from (select id as direction_id, unnest(range(1, 6)) as n, id % 3 as k from directions where id is not null))
    select 'f' || file as file, 'core' as tier, n::int as n, case (file + n) % 4 when 0 then ['BG'] when 1 then ['LR', 'COMP'] when 2 then ['LR'] else ['GAP-RQ1', 'METHOD-基础'] end as tags from l""")
def tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered tag lists in the forms agents write them; a line without a known tag counts as LR."""
    rows = read_table(spark, sf_dir, "directions").where("id is not null").select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))
    kind = (F.col("id") + F.col("n")) % 4
    text = F.concat(F.col("n").cast("string"), F.when(kind == 0, " → BG (2024-2026) — note").when(kind == 1, ": LR+COMP").when(kind == 2, "：nonsense").otherwise(" → GAP-RQ1、METHOD-基础 – note"))
    lines = rows.select(F.concat(F.lit("f"), "id").alias("file"), F.col("n").alias("line_no"), text.alias("line"))
    heads = rows.select("id").distinct().select(F.concat(F.lit("f"), "id").alias("file"), F.lit(0).alias("line_no"), F.lit("## Core").alias("line"))
    return tables.tag_list(lines.unionByName(heads)).select("file", "tier", "n", "tags")


@query("select id::int as direction, (id % 40 + 1)::int as quota from directions where id is not null")
def plan_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of a plan table of which a later row of a direction wins."""
    rows = read_table(spark, sf_dir, "directions").where("id is not null")
    line = lambda quota: F.concat(F.lit("| D"), F.col("id"), F.lit(" | n | t | P | "), quota.cast("string"), F.lit(" 篇 |"))
    first = rows.select(F.lit("plan.md").alias("file"), F.col("id").alias("line_no"), line(F.lit(99)).alias("line"))
    return tables.quotas(first.unionByName(rows.select(F.lit("plan.md").alias("file"), (F.col("id") + 1_000_000).alias("line_no"), line(F.col("id") % 40 + 1).alias("line"))))


@query("select 'a' || id as file, g as tag_group, (50 + id % 9)::int as target, (id % 60)::int as actual, case when id % 5 = 0 then 0.0 else (id % 100) + 0.5 end::double as rate from directions, (select unnest(['BG', 'LR', 'GAP']) as g) where id is not null")
def adequacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of adequacy tables after the warning heading; a rate that is no number counts as 0."""
    rows = read_table(spark, sf_dir, "directions").where("id is not null").select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(("# before", "BG", "## 均衡性预警", "BG", "LR", "GAP", "## next", "LR"))])).alias("x")).select("id", "x.*")
    cells = F.concat(F.lit("| "), "g", F.lit(" | "), (50 + F.col("id") % 9).cast("string"), F.lit(" | "), (F.col("id") % 60).cast("string"), F.lit(" | "), F.when(F.col("id") % 5 == 0, "?").otherwise(F.concat((F.col("id") % 100).cast("string"), F.lit(".5%"))), F.lit(" |"))
    lines = rows.select(F.concat(F.lit("a"), "id").alias("file"), F.col("i").alias("line_no"), F.when(F.col("g").startswith("#"), F.col("g")).otherwise(cells).alias("line"))
    return tables.adequacy_table(lines)


@query("select 'g' || paper_id as file, 'G' || (paper_id % 30) as gap, 'gap of ' || paper_id as text, 'pool/p' || paper_id || '.md' as path from papers")
def gaps_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a table, and paths named within the pool part of a file, one of each a file."""
    number = F.col("paper_id").cast("string")
    parts = F.array(F.lit("`pool/outside.md`"), F.concat(F.lit("| G"), (F.col("paper_id") % 30).cast("string"), F.lit(": gap of "), number, F.lit(" | x |")), F.lit("## 引用池"), F.concat(F.lit("see `pool/p"), number, F.lit(".md` and `not.txt`")), F.lit("## next"), F.lit("`pool/after.bib`"))
    lines = read_table(spark, sf_dir, "papers").select(F.concat(F.lit("g"), number).alias("file"), F.posexplode(parts).alias("line_no", "line"))
    return tables.gap_table(lines).join(tables.pool_paths(lines), "file")


@query("with n as (select distinct batch_id as b from papers where batch_id is not null) select b || case when length(b) % 2 = 0 then '.md' else '.json' end as file from n")
def preferred_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of batches that are there as Markdown and as JSON, the Markdown; raw ones never."""
    names = read_table(spark, sf_dir, "papers").select("batch_id").where("batch_id is not null").distinct()
    kinds = F.when(F.length("batch_id") % 2 == 0, F.array(F.lit(".json"), F.lit(".md"), F.lit("_raw.md"))).otherwise(F.array(F.lit(".json"), F.lit("_raw.md"), F.lit(".txt")))
    return tables.prefer(names.select("batch_id", F.explode(kinds).alias("k")).select(F.concat("batch_id", "k").alias("file")), "file", ["md", "json"]).select("file")


@query("select paper_id, paper_id % 10 <> 3 as readable, case when paper_id % 10 <> 3 then case when paper_id % 5 = 0 then 'He said \"yes\" in ' || paper_id else title end end as title from papers where title is not null")
def json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in JSON: sound ones, some with bare quotes inside a field, some cut off."""
    rows = read_table(spark, sf_dir, "papers").where("title is not null")
    sound = F.to_json(F.struct(F.lit(1).alias("direction"), F.array(F.struct("title", "first_author", "year")).alias("selected")))
    quoted = F.concat(F.lit('{"direction": 1, "selected": [\n{\n"title": "He said "yes" in '), F.col("paper_id").cast("string"), F.lit('",\n"year": 2000\n}\n]}'))
    text = F.when(F.col("paper_id") % 10 == 3, F.substring(sound, F.lit(1), F.length(sound) - 2)).when(F.col("paper_id") % 5 == 0, quoted).otherwise(sound)
    read = tables.batches_of(rows.select(F.col("paper_id").cast("string").alias("file"), text.alias("value")))
    return read.select(F.col("file").cast("long").alias("paper_id"), "readable", F.get("batch.selected", F.lit(0))["title"].alias("title"))


@query("""select n as place, n || ',' || id || ',' || case when regexp_matches(coalesce(name, ''), '[",\\r\\n]') then '"' || replace(name, '"', '""') || '"' else coalesce(name, '') end as line from (select id, name, row_number() over (order by id, name) as n from directions) union all select 0, chr(65279) || '序号,id,name'""")
def numbered_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a numbered CSV for spreadsheets."""
    return writers.csv_lines(read_table(spark, sf_dir, "directions").select("id", "name"), ["id", "name"])


@query("select id, name, issn, tier::varchar as tier from journals")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV with a header and read back, all as text."""
    path = shared_path(spark, "csv")
    read_table(spark, sf_dir, "journals").select("id", "name", "issn", "tier").write.option("header", True).option("escape", '"').csv(path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("""with d as (select doc_id, text, '## 引用池' || chr(10) || 'pool of ' || doc_id || chr(10) as block from documents where not contains(coalesce(text, ''), '## 引用池'))
    select doc_id, case when doc_id % 3 <> 0 then text when trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' then regexp_replace(coalesce(text, ''), '\\n+$', '') || block else regexp_replace(text, '\\n+$', '') || chr(10) || chr(10) || block end as text, doc_id % 3 = 0 as changed from d""")
def block_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool blocks put into every third document; doing it again changes nothing."""
    files = read_table(spark, sf_dir, "documents").where("not contains(coalesce(text, ''), '## 引用池')").select(F.col("doc_id").alias("file"), "text")
    blocks = files.where("file % 3 = 0").select("file", F.concat(F.lit("## 引用池\npool of "), "file").alias("block"))
    once = writers.upsert_blocks(files, "## 引用池", blocks)
    twice = writers.upsert_blocks(once.select("file", "text"), "## 引用池", blocks).where("changed")
    return once.join(twice.select("file"), "file", "left_anti").select(F.col("file").alias("doc_id"), "text", "changed")


@query(f"""with {_LEADING}, t as (select direction, row_number() over (partition by direction order by rank, n) as k, title, year from lead)
    select direction, '| # | title | year |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || k || ' | ' || regexp_replace(replace(coalesce(title, ''), '|', '/'), '\\r?\\n', ' ', 'g') || ' | ' || year || ' |', chr(10) order by k) as markdown from t group by direction""")
def direction_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown page of the leading records of each direction."""
    return writers.report_table(_leading(spark, sf_dir).withColumn("year", F.col("year").cast("string")), "direction", ["rank", "n"], ["title", "year"])


@query("select paper_id, 'S' || paper_id as pii, case when paper_id % 2 = 0 then 'A long title of record ' || paper_id else 'Another long title of it' end as title from papers")
def article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of issue pages, one page a record: short texts and PDF links are none, the first of an id counts."""
    number = F.col("paper_id").cast("string")
    link = lambda text: F.concat(F.lit('<a class="x" href="/science/pii/S'), number, F.lit('?q">'), text, F.lit("</a>\n"))
    first = F.when(F.col("paper_id") % 2 == 0, link(F.concat(F.lit("A long title of <b>record</b> "), number))).otherwise("")
    html = F.concat(link(F.lit("short")), link(F.lit("View PDF of this article")), first, link(F.lit("Another long title of it")))
    return tables.article_links(read_table(spark, sf_dir, "papers").select("paper_id", html.alias("html")), "html", "paper_id").select("paper_id", "pii", "title")


@query("with c as (select direction, kind, case kind when 'table' then paper_id % 5 else paper_id % 7 end::int as number, (paper_id % 11)::bigint as page from papers, (select unnest(['table', 'figure']) as kind) where direction is not null) select direction, kind, number, min(page) as page from c group by all")
def caption_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page on which each table and figure of a direction is captioned."""
    text = F.concat(F.lit("see Table 1\nTable "), (F.col("paper_id") % 5).cast("string"), F.lit(". x\nFig"), F.when(F.col("paper_id") % 2 == 0, "ure").otherwise("."), F.lit(" "), (F.col("paper_id") % 7).cast("string"), F.lit(" y"))
    pages = read_table(spark, sf_dir, "papers").where("direction is not null").select("direction", text.alias("text"), (F.col("paper_id") % 11).alias("page"))
    return tables.captions(pages, by="direction")


_FIGURE = "case p_partkey % 6 when 0 then ['#576fa0'] when 1 then ['#000000', '#576fa0'] when 2 then [] when 3 then ['#123456'] when 4 then ['#a7b9d7', '#e3b87f'] else [] end"


@query(
    f"""with f as (select p_partkey, {_FIGURE} as c, p_partkey % 3 as k from part), s as (select *, case when len(c) = 0 then 'N/A' when p_partkey % 6 in (0, 4) then 'FULL' when p_partkey % 6 = 1 then 'PARTIAL' else 'NONE' end as palette, p_size % 2 = 0 as has_font, case when k = 0 then [] when p_size % 3 = 0 then ['png'] when p_size % 3 = 1 then ['pdf'] else [] end as fmt from f join part using (p_partkey))
    select case k when 0 then 'tikz' when 1 then 'python' else 'R' end as tool, 'f' || p_partkey || case k when 0 then '.tex' when 1 then '.py' else '.R' end as file, len(c)::int as colours, palette, case when has_font then 'OK' else 'MISS' end as font, case when k = 0 then 'PDF' when len(fmt) > 0 then fmt[1] else '?' end as format,
    list_filter([case palette when 'NONE' then 'no palette colours' when 'PARTIAL' then 'other colours' end, case when not has_font then 'missing font' end, case when len(fmt) > 0 and fmt[1] = 'png' then 'png output' end], lambda x: x is not null) as issues from s"""
)
def figure_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure sources made for parts: their styles, the inventory and what is wrong with them."""
    part = read_table(spark, sf_dir, "part")
    kind, colour = F.col("p_partkey") % 3, F.col("p_partkey") % 6
    hexes = F.when(colour == 0, "c('#576FA0')").when(colour == 1, "'#000000' \"#576fa0\"").when(colour == 3, "'#123456'").when(colour == 4, "'#a7b9d7','#E3B87F'").otherwise("")
    font = F.when(F.col("p_size") % 2 != 0, "").when(kind == 0, "\\usepackage[x]{newtxtext}\n").when(kind == 1, "rcParams['font.serif'] = ['Times New Roman']\n").otherwise("theme(base_family = 'Times')\n")
    suffix = F.when(F.col("p_size") % 3 == 0, "png").otherwise("pdf")
    saved = F.when((F.col("p_size") % 3 == 2) | (kind == 0), "").when(kind == 1, F.concat(F.lit("plt.savefig('x."), suffix, F.lit("', dpi=300)"))).otherwise(F.concat(F.lit("ggsave('x."), suffix, F.lit("', width = 5)")))
    name = F.concat(F.lit("figures/f"), "p_partkey", F.when(kind == 0, ".tex").when(kind == 1, ".py").otherwise(".R"))
    styles = tables.figure_styles(part.select(name.alias("file"), F.concat(font, hexes, F.lit("\n"), saved).alias("text")))
    return tables.figure_inventory(styles.select("*")).join(styles.select(F.substring_index("file", "/", -1).alias("file"), "issues"), "file").select("tool", "file", "colours", "palette", "font", "format", "issues")


@query("select p_partkey::varchar as id, p_name as name, case when p_size % 3 = 0 then 0 else p_partkey * 1000 end::bigint as mtime, [p_brand, p_type] as tags from part where p_size % 5 <> 0")
def live_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metadata written as JSON: deleted images are left out, a missing time is 0."""
    part = read_table(spark, sf_dir, "part")
    doc = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("tags"), F.when(F.col("p_size") % 3 != 0, F.col("p_partkey") * 1000).alias("mtime"), F.when(F.col("p_size") % 5 == 0, True).when(F.col("p_size") % 5 == 1, False).alias("isDeleted"))
    path = shared_path(spark, "images")
    part.select(F.to_json(doc).alias("text")).write.text(path)
    return tables.live_images(spark.read.schema(tables.IMAGE).json(path)).select("id", "name", "mtime", "tags")


@query("""select item_id, case when item_id % 3 = 0 then 7 when item_id % 3 = 1 then (item_id % 9 + 1)::int else 1 end::int as batch, 'topic' as direction_name from dispatch_items""")
def dispatch_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch numbers of agents: their own, else from how the work was split; the direction's name from the file."""
    kind = F.col("item_id") % 3
    split = F.when(kind == 1, F.concat((F.col("item_id") % 9 + 1).cast("string"), F.lit("/9")))
    name = F.concat(F.lit("data/"), (F.col("item_id") % 40).cast("string"), F.lit("_topic"), F.when(kind == 0, "_cnki").when(kind == 1, "_zone2_llm").otherwise(""), F.lit(".ris"))
    rows = read_table(spark, sf_dir, "dispatch_items").select("item_id", F.when(kind == 0, 7).alias("batch_seq"), split.alias("split_info"), name.alias("source_file"))
    return reports.dispatch_metadata(rows).select("item_id", "batch", "direction_name")


@query("select tag, count(*)::bigint as plans, sum(id % 20)::bigint as items, list_sort(list(id::int)) as directions from (select id, unnest(list_distinct(tags)) as tag from directions where tags is not null) where tag is not null group by tag")
def pool_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag groups of pool plans, one plan a direction."""
    own = F.array_distinct(F.filter("tags", lambda t: t.isNotNull()))
    groups = F.map_from_entries(F.transform(own, lambda t: F.struct(t, F.struct((F.col("id") % 20).alias("count"), F.array("id").alias("source_directions")))))
    plans = read_table(spark, sf_dir, "directions").where("tags is not null").select(groups.alias("tag_groups"))
    items = reports.tag_group_items(plans)
    return items.groupBy("tag").agg(F.count(F.lit(1)).alias("plans"), F.sum("item_count").cast("long").alias("items"), F.array_sort(F.flatten(F.collect_list("source_directions"))).alias("directions"))


@query("select source, arg_min(doc_id, (case lang when 'zh' then 0 else 1 end, doc_id)) as doc_id, arg_min(lang, (case lang when 'zh' then 0 else 1 end, doc_id)) as lang from documents where lang in ('zh', 'en') group by source")
def best_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each source in the first language of the order that it has, the smallest id standing for a language."""
    docs = read_table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    return tables.best_language(docs, "source", "lang").select("source", "doc_id", "lang")


@query("""with d as (select doc_id, text from documents where source like 'pool_notes%' and text is not null)
    select doc_id, 'k' || doc_id || 'a' as citation_key, '核心' as grade from d union all select doc_id, null, '重要' from d""")
def pool_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool entries of filled templates, and blocks that have fields but no key; slots left open have no value."""
    docs = read_table(spark, sf_dir, "documents").where("source like 'pool_notes%' and text is not null")
    text = F.concat(F.lit("## 标签\n### one\n- **citation_key**: k"), F.col("doc_id"), F.lit("a\n- 分级：核心\n- 引用场景: {{scene}}\n### two\n- grade: 重要\n- key: {{key}}\n### three\nno fields\n"))
    keyed, bare = letters.pool_entries(docs.select("doc_id", text.alias("text")), "doc_id", "text")
    pick = lambda rows: rows.select("doc_id", F.try_element_at("fields", F.lit("citation_key")).alias("citation_key"), F.try_element_at("fields", F.lit("分级")).alias("grade"))
    return pick(keyed).unionByName(pick(bare))

"""Markdown reports, tag lists and metadata as DataFrames, read line by line."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscale.functions import text as X
from folioscale.operators.letters import lines
from folioscale.operators.sequences import carry_forward
from folioscale.operators.tags import VOCABULARY

#: Headings of tiers, and of parts that end them.
_TIERS = {"core": r"(?i)^##\s.*(核心文献|Core)", "important": r"(?i)^##\s.*(重要文献|Important)", "backup": r"(?i)^##\s.*(备选文献|Backup)"}
_END = r"^##\s.*(淘汰|小结|逐篇)"


def report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return lines(files, "file", "text")


def with_tier(rows: DataFrame) -> DataFrame:
    """Lines with the tier of the heading above; other headings of parts end it."""
    heading = F.lit(None)
    for tier, pattern in _TIERS.items():
        heading = F.when(F.col("line").rlike(pattern), tier).otherwise(heading)
    heading = F.when(F.col("line").rlike(_END), F.lit("")).otherwise(heading)
    return carry_forward(rows, heading, "file", "line_no", "tier").withColumn("tier", F.nullif("tier", F.lit("")))


def cells(line: Column) -> Column:
    """Cells of a pipe table row; \\| is no separator; inner empty cells stay."""
    guarded = F.replace(F.trim(line), F.lit("\\|"), F.lit("\x01"))
    inner = F.regexp_replace(guarded, r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda cell: F.trim(F.replace(cell, F.lit("\x01"), F.lit("|"))))


def tag_cell(cell: Column, closed: bool = True) -> Column:
    """Tags of a cell; marks for nothing give none. closed keeps only known prefixes."""
    plain = F.trim(F.regexp_replace(cell, "`", ""))
    parts = F.filter(F.transform(F.split(F.regexp_replace(plain, r"\|", ";"), r"[+,、/;]"), lambda t: F.trim(t)), lambda t: t != "")
    if closed:
        parts = F.filter(parts, lambda t: t.rlike(r"^(BG|LR|COMP|METHOD|GAP|DISC)"))
    return F.when(plain.isin("—", "-", "N/A", ""), F.array().cast("array<string>")).otherwise(parts)


def paper_tables(rows: DataFrame, closed: bool = True) -> DataFrame:
    """(file, line_no, tier, n, author, title, year, journal, tags, reason) of rows with 7 or 6 columns under a tier.

    Rows need a number and a four-digit year; 6 columns have no tags.
    """
    cut = with_tier(rows).where(F.col("tier").isNotNull() & F.col("line").rlike(r"^\s*\|\s*\d+\s*\|")).withColumn("c", cells(F.col("line")))
    cut = cut.where(F.size("c").isin(6, 7) & F.get("c", F.lit(3)).rlike(r"^\d{4}$"))
    seven = F.size("c") == 7
    return cut.select(
        "file", "line_no", "tier", F.get("c", F.lit(0)).cast("int").alias("n"), F.get("c", F.lit(1)).alias("author"), F.get("c", F.lit(2)).alias("title"), F.get("c", F.lit(3)).cast("int").alias("year"), F.get("c", F.lit(4)).alias("journal"),
        F.when(seven, tag_cell(F.get("c", F.lit(5)), closed)).otherwise(F.array().cast("array<string>")).alias("tags"), F.when(seven, F.get("c", F.lit(6))).otherwise(F.get("c", F.lit(5))).alias("reason"),
    )


def pool_table(rows: DataFrame) -> DataFrame:
    """Table rows after a separator row, their cells by place (empty cells keep theirs)."""
    separator = F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$")
    state = F.when(separator, True).when(~F.coalesce(F.col("line").rlike(r"^\s*\|"), F.lit(False)), False)
    marked = carry_forward(rows, state, "file", "line_no", "inside")
    return marked.where(F.col("inside") & ~separator & F.col("line").rlike(r"^\s*\|")).select("file", "line_no", cells(F.col("line")).alias("cells"))


def row_counts(rows: DataFrame) -> DataFrame:
    """(file, tier, n): numbered table rows of each report by tier."""
    return with_tier(rows).where(F.col("line").rlike(r"^\|\s*\d+\s*\|")).groupBy("file", "tier").agg(F.count(F.lit(1)).alias("n"))


def quotas(rows: DataFrame) -> DataFrame:
    """(direction, quota) of plan tables; a later row of a direction wins."""
    pattern = r"\|\s*D?(\d+)\s*\|[^|]+\|[^|]+\|[^|]+\|\s*(\d+)\s*篇\s*\|"
    found = rows.where(F.col("line").rlike(pattern)).select(F.regexp_extract("line", pattern, 1).cast("int").alias("direction"), F.regexp_extract("line", pattern, 2).cast("int").alias("quota"), F.struct("file", "line_no").alias("place"))
    return found.groupBy("direction").agg(F.max_by("quota", "place").alias("quota"))


def tag_list(rows: DataFrame) -> DataFrame:
    """(file, tier, n, tags) of lines `N → TAGS` or `N: TAGS`; notes after a dash are cut; no known tag gives LR."""
    pattern = r"^\s*(\d+)\s*(?:→|[:：])\s*(.+)$"
    kept = with_tier(rows).where(F.col("tier").isNotNull() & F.col("line").rlike(pattern))
    raw = F.trim(F.get(F.split(F.regexp_extract("line", pattern, 2), r"\s*[—–]\s"), F.lit(0)))
    parts = F.transform(F.split(raw, r"[+,、]\s*"), lambda t: F.when(F.trim(t).rlike(r"^BG\s*\("), "BG").otherwise(F.trim(t)))
    known = F.filter(parts, lambda t: t.isin(*VOCABULARY))
    found = kept.select("file", "tier", F.regexp_extract("line", pattern, 1).cast("int").alias("n"), F.when(F.size(known) == 0, F.array(F.lit("LR"))).otherwise(known).alias("tags"), "line_no")
    return found.groupBy("file", "tier", "n").agg(F.max_by("tags", "line_no").alias("tags"))


def batch_metadata(rows: DataFrame) -> DataFrame:
    """(file, direction, total, source_type, meta): `> key: value` lines, else `- key: value`, else the file name."""
    pattern = lambda mark: r"^\s*" + mark + r"\s*([A-Za-z_]+)\s*[:：]\s*(.+?)\s*$"
    pick = lambda mark, name: rows.where(F.col("line").rlike(pattern(mark))).groupBy("file", F.lower(F.regexp_extract("line", pattern(mark), 1)).alias("k")).agg(F.max_by(F.regexp_extract("line", pattern(mark), 2), "line_no").alias("v")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))
    both = rows.select("file").distinct().join(pick(">", "quoted"), "file", "left").join(pick("-", "listed"), "file", "left")
    get = lambda m, key: F.try_element_at(m, F.lit(key))
    number = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1).cast("string"), F.lit("")).cast("int")
    own = number(get("quoted", "direction"))
    use = F.when(F.coalesce(own, F.lit(0)) > 0, F.col("quoted")).otherwise(F.coalesce("listed", "quoted"))
    named = F.nullif(F.regexp_extract("file", r"(?:^|[/\\])d(\d+)_batch", 1), F.lit("")).cast("int")
    return both.withColumn("meta", use).select("file", F.coalesce(F.nullif(number(get("meta", "direction")), F.lit(0)), named, F.lit(0)).alias("direction"), number(get("meta", "total_items")).alias("total"), get("meta", "source_type").alias("source_type"), "meta")


def gap_table(rows: DataFrame) -> DataFrame:
    """(file, gap, text) of rows `| G1: text |`."""
    pattern = r"^\|\s*(G\d+)[:\s]*(.+?)\s*\|"
    return rows.where(F.col("line").rlike(pattern)).select("file", F.regexp_extract("line", pattern, 1).alias("gap"), F.regexp_extract("line", pattern, 2).alias("text"))


def pool_paths(rows: DataFrame) -> DataFrame:
    """(file, path): .md and .bib paths in back quotes within the pool part of a file."""
    heading = F.when(F.col("line").rlike(r"^##\s"), F.col("line").contains("引用池"))
    inside = carry_forward(rows, heading, "file", "line_no", "inside").where("inside")
    return inside.select("file", F.explode(F.regexp_extract_all("line", F.lit(r"`([^`]+\.(?:md|bib))`"), 1)).alias("path")).distinct()


def adequacy_table(rows: DataFrame) -> DataFrame:
    """(file, tag_group, target, actual, rate) after the warning heading, up to the next heading; a bad rate is 0."""
    inside = carry_forward(rows, F.when(F.col("line").rlike(r"^#"), F.col("line").contains("均衡性预警")), "file", "line_no", "inside").where("inside").withColumn("c", cells(F.col("line")))
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.get("c", F.lit(i)), F.lit("")), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))
    return inside.where(F.get("c", F.lit(0)).isin("BG", "LR", "GAP", "METHOD", "DISC")).select("file", F.get("c", F.lit(0)).alias("tag_group"), number(1).cast("int").alias("target"), number(2).cast("int").alias("actual"), number(3).alias("rate"))


def prefer(files: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """One file a stem: the first suffix in order that it has; raw ones are left out."""
    suffix = F.regexp_extract(ident, r"\.([A-Za-z]+)$", 1)
    stem = F.regexp_replace(ident, r"\.[A-Za-z]+$", "")
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), suffix)
    kept = files.where((rank > 0) & ~stem.endswith("_raw"))
    return kept.groupBy(stem.alias("stem")).agg(F.min_by(ident, rank).alias(ident))


_STRINGS = ("title", "first_author", "journal", "tier", "reason")


def repair_json(text: str) -> str | None:
    """A batch in JSON, with quotes inside the five string fields escaped if it cannot be read; null if it still cannot."""
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    fixed = []
    for line in text.split("\n"):
        found = re.match(r'^(\s*"(' + "|".join(_STRINGS) + r')"\s*:\s*")(.*)("\s*,?\s*)$', line)
        fixed.append(found[1] + re.sub(r'(?<!\\)"', r"\\" + '"', found[3]) + found[4] if found else line)
    try:
        json.loads("\n".join(fixed))
        return "\n".join(fixed)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair_json, na_action="ignore")


#: Batches of screened records in JSON.
BATCH = "direction int, direction_name string, batch_id string, total_items int, source_type string, selected array<struct<title string, first_author string, year int, journal string, tier string, reason string>>"


def json_batches(spark: SparkSession, path: str) -> DataFrame:
    """(file, batch, readable): batches with inner quotes repaired; those that stay unreadable are kept as such."""
    return batches_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def batches_of(files: DataFrame) -> DataFrame:
    """As json_batches, of texts (file, value)."""
    return files.withColumn("fixed", _repaired("value")).select("file", F.from_json("fixed", BATCH).alias("batch"), F.col("fixed").isNotNull().alias("readable"))


#: Metadata of an image.
IMAGE = "id string, name string, ext string, annotation string, tags array<string>, width int, height int, mtime long, isDeleted boolean"


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image metadata files (*.info/metadata.json), deleted ones left out; mtime 0 if missing."""
    return live_images(spark.read.schema(IMAGE).json(path, multiLine=True))


def live_images(rows: DataFrame) -> DataFrame:
    """Image metadata without deleted ones; mtime 0 if missing."""
    return rows.where("not coalesce(isDeleted, false)").withColumn("mtime", F.coalesce("mtime", F.lit(0)))


#: The eight colours of the palette.
PALETTE = ("#576fa0", "#a7b9d7", "#e3b87f", "#fadcb4", "#b57979", "#dea3a2", "#9f9f9f", "#cfcece")


def figure_styles(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, tool, colours, palette, has_font, dpi, formats, issues) of figure sources in TikZ, Python or R; others are left out."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), 1)))
    tool = F.when(F.col(file).rlike(r"\.tex$"), "tikz").when(F.col(file).rlike(r"\.py$"), "python").when(F.col(file).rlike(r"\.[Rr]$"), "R")
    hexes = F.array_sort(F.array_distinct(F.transform(F.when(tool == "tikz", every("(#[0-9a-fA-F]{6})")).otherwise(every(r"['\"](#[0-9a-fA-F]{6})['\"]")), F.lower)))
    font = F.when(tool == "tikz", F.exists(every(r"\\usepackage(?:\[.*?\])?\{([^}]*)\}"), lambda name: F.contains(name, F.lit("newtxtext")))).when(tool == "python", body.contains("Times New Roman") | body.rlike(r"font\.serif['\"]?\s*[:\]]\s*\[?\s*['\"][^'\"]*Times")).otherwise(F.exists(every(r"family\s*=\s*['\"]([^'\"]+)['\"]"), lambda name: F.contains(name, F.lit("Times"))))
    saved = F.when(tool == "python", every(r"savefig\(['\"].*?\.(pdf|png|svg|eps)['\"]")).when(tool == "R", F.array_sort(F.array_distinct(F.concat(every(r"ggsave\(\s*['\"].*?\.(pdf|png|svg|eps)['\"]"), every(r"device\s*=\s*['\"](\w+)['\"]"))))).otherwise(F.array().cast("array<string>"))
    out = files.withColumn("tool", tool).where("tool is not null").select(F.col(file).alias("file"), "tool", hexes.alias("colours"), font.alias("has_font"), every(r"dpi\s*=\s*(\d+)").alias("dpi"), saved.alias("formats"))
    out = out.withColumn("palette", X.palette("colours", PALETTE))
    issues = F.array_compact(F.array(F.when(F.col("palette") == "NONE", F.lit("no palette colours")).when(F.col("palette") == "PARTIAL", F.lit("other colours")), F.when(~F.col("has_font"), F.lit("missing font")), F.when(F.array_contains("formats", "png"), F.lit("png output"))))
    return out.withColumn("issues", issues)


def figure_inventory(styles: DataFrame) -> DataFrame:
    """(tool, file, colours, palette, font, format): a line of the inventory for each figure source."""
    shown = F.when(F.col("tool") == "tikz", "PDF").when(F.size("formats") > 0, F.array_join("formats", ",")).otherwise("?")
    return styles.select("tool", F.substring_index("file", "/", -1).alias("file"), F.size("colours").alias("colours"), "palette", F.when(F.col("has_font"), "OK").otherwise("MISS").alias("font"), shown.alias("format"))


def captions(pages: DataFrame, text: str = "text", page: str = "page", by: str = "doc_id") -> DataFrame:
    """(by, kind, number, page): the first page on which a table or figure is captioned."""
    line = F.explode(F.split(text, "\n")).alias("line")
    found = pages.select(by, page, line).withColumns({"table": F.regexp_extract("line", r"^Table\s+(\d+)[.\s]", 1), "figure": F.regexp_extract("line", r"^Fig(?:ure)?\.?\s*(\d+)[.\s]", 1)})
    kind = F.when(F.col("table") != "", "table").when(F.col("figure") != "", "figure")
    number = F.when(F.col("table") != "", F.col("table")).otherwise(F.col("figure"))
    return found.withColumn("kind", kind).where("kind is not null").groupBy(by, "kind", number.cast("int").alias("number")).agg(F.min(page).alias("page"))


def article_links(pages: DataFrame, html: str = "html", by: str = "page_id") -> DataFrame:
    """(by, pii, title): links of an issue page, the first of each id; short texts and PDF links left out."""
    pattern = r"(?s)<a[^>]+href=\"[^\"]*/pii/([A-Z0-9]+)[^\"]*\"[^>]*>(.*?)</a>"
    zipped = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), 1).alias("pii"), F.regexp_extract_all(html, F.lit(pattern), 2).alias("title"))
    rows = pages.select(by, F.posexplode(zipped).alias("at", "z")).select(by, "at", F.col("z.pii").alias("pii"), F.trim(F.regexp_replace(F.col("z.title"), "<[^>]+>", "")).alias("title"))
    kept = rows.where((F.length("title") >= 20) & ~F.col("title").rlike("(?i)(?:view|download) pdf"))
    return kept.groupBy(by, "pii").agg(F.min_by("title", "at").alias("title"))


def best_language(rows: DataFrame, by: str, language: str, order: tuple[str, ...] = ("zh-Hant", "zh-Hans", "zh", "en")) -> DataFrame:
    """One row a group: the first language in order that it has."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(language))
    others = [c for c in rows.columns if c != by]
    return rows.where(rank > 0).groupBy(by).agg(F.min_by(F.struct(*others), rank).alias("r")).select(by, "r.*")

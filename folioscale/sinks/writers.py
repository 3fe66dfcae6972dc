"""Records, reports and edits of files, as columns of text and guarded writes."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscale.functions import text as X
from folioscale.runtime import cut_lineage
from folioscale.sources.records import value, values

#: Document types of EndNote exports and of RIS, and entry types of BibTeX.
ENW_TYPES = {"Journal Article": "JOUR", "Newspaper Article": "NEWS", "Thesis": "THES", "Dissertation": "THES", "Conference Proceedings": "CONF", "Conference Paper": "CONF", "Book": "BOOK", "Book Section": "CHAP", "Report": "RPRT", "Patent": "PAT"}
BIB_TYPES = {"JOUR": "article", "ABST": "article", "CONF": "inproceedings", "CPAPER": "inproceedings", "BOOK": "book", "EDITED": "book", "CHAP": "incollection", "CHAPT": "incollection", "THES": "phdthesis", "DISS": "phdthesis", "RPRT": "techreport"}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _tag_lines(tag: str, items: Column) -> Column:
    """`TAG  - value` lines of an array."""
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit(f"{tag}  - "), item)), "\n")


def _joined(*parts: Column) -> Column:
    """Non-empty parts as lines."""
    return F.array_join(F.filter(F.array(*parts), lambda part: part.isNotNull() & (part != "")), "\n")


def ris_text(fields: Column) -> Column:
    """A record in RIS: type first (JOUR if none), other tags in order, an ER line and an empty line."""
    rest = F.filter(F.map_keys(fields), lambda tag: ~tag.isin("TY", "ER"))
    body = F.array_join(F.flatten(F.transform(rest, lambda tag: F.transform(fields[tag], lambda item: F.concat(tag, F.lit("  - "), item)))), "\n")
    kind = F.coalesce(value("TY", fields), F.lit("JOUR"))
    return F.concat(_joined(F.concat(F.lit("TY  - "), kind), body), F.lit("\nER  - \n"))


def enw_to_ris(records: DataFrame, skip_newspapers: bool = False) -> DataFrame:
    """EndNote records with their RIS text in fixed order; Chinese is marked, since the exports do not say."""
    kind = F.coalesce(value("%0"), F.lit("Journal Article"))
    year = X.record_year(value("%D"), value("%8"), value("%U"), value("%R"))
    rows = records.where(kind != "Newspaper Article") if skip_newspapers else records
    named = lambda tag, items: _tag_lines(tag, F.filter(F.transform(items, X.strip), lambda x: x != ""))
    page = F.transform(values("%P"), X.pages)
    text = _joined(
        F.concat(F.lit("TY  - "), F.coalesce(_map(ENW_TYPES)[kind], F.lit("GEN"))), named("AU", values("%A")), named("TI", values("%T")), named("T2", values("%J")), F.concat(F.lit("PY  - "), year), named("AB", values("%X")),
        named("KW", F.flatten(F.transform(values("%K"), X.keywords))), _tag_lines("SP", F.filter(F.transform(page, lambda p: p["first"]), lambda x: x != "")), _tag_lines("EP", F.filter(F.transform(page, lambda p: p["last"]), lambda x: x != "")),
        named("SN", values("%@")), named("DO", values("%R")), named("UR", values("%U")), named("AD", values("%+")), named("PB", values("%I")),
        named("N1", F.transform(values("%W"), lambda x: F.concat(F.lit("DS:"), x))), named("N1", F.transform(values("%L"), lambda x: F.concat(F.lit("CN:"), x))), F.lit("N1  - LA:zh"), F.lit("ER  - "),
    )
    return rows.withColumns({"kind": kind, "year": year, "ris": text})


def conversion_counts(converted: DataFrame, records: DataFrame) -> DataFrame:
    """One row: records in, converted, skipped, without a year, with one found elsewhere than in the date."""
    done = converted.select(F.lit(True).alias("done"), F.col("year").isNull().alias("no_year"), (F.col("year").isNotNull() & value("%D").isNull()).alias("found_year"))
    both = done.unionByName(records.select(F.lit(False).alias("done"), F.lit(False).alias("no_year"), F.lit(False).alias("found_year")))
    counts = both.agg(F.count_if(~F.col("done")).alias("records"), F.count_if("done").alias("converted"), F.count_if("no_year").alias("no_year"), F.count_if("found_year").alias("found_year"))
    return counts.select("records", "converted", (F.col("records") - F.col("converted")).alias("skipped"), "no_year", "found_year")


def ris_to_bibtex(key: Column, fields: Column, author: Column, title: Column, journal: Column, year: Column) -> Column:
    """A BibTeX entry of a RIS record, with the fallbacks for what it lacks."""
    get = lambda tag: F.nullif(value(tag, fields), F.lit(""))
    kind = F.coalesce(_map(BIB_TYPES)[F.coalesce(get("TY"), F.lit("JOUR"))], F.lit("article"))
    authors = F.coalesce(F.nullif(F.array_join(values("AU", fields), " and "), F.lit("")), author)
    line = lambda name, text: F.concat(F.lit(f"  {name} = {{"), text, F.lit("},"))
    venue = F.coalesce(get("T2"), get("JO"), get("JF"), F.nullif(journal, F.lit("")))
    page = F.when(get("SP").isNotNull() & get("EP").isNotNull(), F.concat_ws("--", get("SP"), get("EP"))).otherwise(get("SP"))
    chinese = F.exists(values("N1", fields), lambda note: F.contains(note, F.lit("LA:zh")))
    return _joined(
        F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",")), line("author", X.bibtex_escape(authors)), F.concat(F.lit("  title = {{"), X.bibtex_escape(F.coalesce(get("TI"), title)), F.lit("}},")),
        F.when(venue.isNotNull(), F.concat(F.lit("  "), F.when(kind == "article", "journal").otherwise("booktitle"), F.lit(" = {"), X.bibtex_escape(venue), F.lit("},"))),
        line("year", F.left(F.coalesce(get("PY"), year.cast("string")), F.lit(4))), line("volume", get("VL")), line("number", get("IS")), line("pages", page), line("doi", F.coalesce(get("DO"), get("DI"))),
        F.when(chinese, F.lit("  language = {chinese},")), F.lit("}"),
    )


def stub_bibtex(key: Column, author: Column, title: Column, journal: Column, year: Column) -> Column:
    """An entry to be completed by hand."""
    line = lambda name, text: F.concat(F.lit(f"  {name} = {{"), X.bibtex_escape(text), F.lit("},"))
    return _joined(F.concat(F.lit("@article{"), key, F.lit(",")), line("author", author), line("title", title), F.when(F.coalesce(journal, F.lit("")) != "", line("journal", journal)), line("year", year.cast("string")), F.lit("  note = {TODO: Complete this entry manually},"), F.lit("}"))


def rekeyed(raw: Column, old: Column, new: Column) -> Column:
    """A raw BibTeX entry under another key."""
    rest = F.substring(raw, F.length(F.substring_index(raw, ",", 1)) + 1, F.length(raw))
    return F.when(F.substring_index(raw, ",", 1).endswith(old), F.concat(F.substring_index(raw, "{", 1), F.lit("{"), new, rest)).otherwise(raw)


def new_entries(wanted: DataFrame, target: DataFrame, master: DataFrame, key: str = "key") -> DataFrame:
    """Entries of the master that are wanted and that the target lacks, by key; append them to the target."""
    return master.join(wanted.select(key).distinct(), key, "left_semi").join(target.select(key), key, "left_anti").orderBy(key)


def report_table(rows: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """(by, markdown): a numbered pipe table a group. Meant for reports: a group is a page."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    cells = [X.table_cell(F.col(c).cast("string")) for c in columns]
    lines = rows.withColumn("n", n).select(by, "n", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("n").cast("string"), *cells), F.lit(" |")).alias("line"))
    head = "| # | " + " | ".join(columns) + " |\n|" + "---|" * (len(columns) + 1) + "\n"
    return lines.groupBy(by).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], "\n")).alias("markdown"))


def replace_block(text: str, heading: str, block: str) -> tuple[str, bool]:
    """(text, changed): the part under a heading replaced, up to the next of its level or the end; appended if absent."""
    block = block.rstrip("\n") + "\n"
    found = re.search(r"(?ms)^" + re.escape(heading) + r"[^\n]*\n.*?(?=^##\s|\Z)", text)
    if found:
        out = text[: found.start()] + block + ("\n" if found.end() < len(text) else "") + text[found.end() :].lstrip("\n")
    else:
        out = text.rstrip("\n") + ("\n\n" if text.strip() else "") + block
    return out, out != text


def upsert_blocks(files: DataFrame, heading: str, blocks: DataFrame) -> DataFrame:
    """Files (file, text) with the blocks (file, block) put under the heading; applying it twice changes nothing more."""

    @F.pandas_udf(T.StringType())
    def put(texts: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([replace_block(text or "", heading, block)[0] if block is not None else text for text, block in zip(texts, new)])

    joined = files.join(blocks, "file", "left")
    return joined.withColumn("new_text", put("text", "block")).withColumn("changed", ~F.col("new_text").eqNullSafe(F.col("text"))).select("file", F.col("new_text").alias("text"), "changed")


def insert_column(rows: DataFrame, header: str, tags: DataFrame) -> DataFrame:
    """Report lines (file, line_no, line, tier) with a tag cell before the last, or in its place if the header has it.

    tags: file, tier, n, tags. Rows are matched by their number, else by their
    place in the tier; a row without tags keeps its line and is marked missing.
    """
    numbered = F.col("line").rlike(r"^\|\s*\d+\s*\|")
    n = F.nullif(F.regexp_extract("line", r"^\|\s*(\d+)\s*\|", 1), F.lit("")).cast("int")
    place = F.sum(numbered.cast("int")).over(Window.partitionBy("file", "tier").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumns({"n": n, "place": F.when(numbered, place).cast("int")})
    by_number = tags.select("file", "tier", "n", F.array_join("tags", "+").alias("own"))
    by_place = tags.select("file", "tier", F.col("n").alias("place"), F.array_join("tags", "+").alias("other"))
    joined = marked.join(by_number, ["file", "tier", "n"], "left").join(by_place, ["file", "tier", "place"], "left").withColumn("tag", F.coalesce("own", "other"))
    guarded = F.replace("line", F.lit("\\|"), F.lit("\x01"))
    put = lambda cell: F.replace(F.regexp_replace(guarded, r"\|\s*([^|]*)\|\s*$", F.concat(F.lit("| "), cell, F.lit(" | $1|"))), F.lit("\x01"), F.lit("\\|"))
    line = F.when(numbered & F.col("tag").isNotNull(), put(F.col("tag"))).when(F.col("line").rlike(r"^\|\s*#\s*\|"), put(F.lit(header))).when(F.col("line").rlike(r"^\|[\s:|-]+\|\s*$"), put(F.lit("---"))).otherwise(F.col("line"))
    return joined.select("file", "line_no", "tier", line.alias("line"), (numbered & F.col("tag").isNull()).alias("missing"))


class NothingToWrite(ValueError):
    """Raised instead of overwriting data with nothing."""


def guarded_overwrite(rows: DataFrame, path: str, least: int = 1) -> int:
    """Replace a Parquet table, but never by fewer than `least` rows; the rows are staged first, so they may come from it."""
    from folioscale.streaming.incremental import swap_in

    rows = cut_lineage(rows)
    n = rows.count()
    if n < least:
        raise NothingToWrite(f"{n} rows for {path}; at least {least} are wanted")
    swap_in(rows, path)
    return n


def write_chunks(items: DataFrame, parts: DataFrame, ident: str, path: str) -> None:
    """One folder a part: items (ident, n from 1) of the ranges of parts (ident, part, range_start, range_end)."""
    ranged = items.join(parts.select(ident, "part", "range_start", "range_end"), ident).where("n between range_start and range_end")
    ranged.drop("range_start", "range_end").repartition(ident, "part").write.partitionBy(ident, "part").mode("overwrite").json(path)


#: Rows a spreadsheet can show.
SHEET_ROWS = 1_048_575


def csv_lines(rows: DataFrame, order: list[str], number: str = "序号") -> DataFrame:
    """(place, line): the lines of a numbered CSV, place 0 being the header after a byte-order mark.

    Numbered by a distributed sort: each partition starts where the counts of those before it end.
    """
    spark = rows.sparkSession
    ordered = rows.orderBy(*order).withColumn("_part", F.spark_partition_id())
    ordered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    sizes = {row["_part"]: row["n"] for row in ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    first = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    place = (F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy("_at"))).alias("place")
    text = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    quoted = lambda cell: F.when(cell.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)
    lines = ordered.join(first, "_part").select(place, F.concat_ws(",", place.cast("string"), *[quoted(text(name)) for name in rows.columns]).alias("line"))
    head = spark.createDataFrame([(0, "\ufeff" + ",".join([number, *rows.columns]))], "place long, line string")
    return head.unionByName(lines)


def write_csv_with_bom(rows: DataFrame, order: list[str], path: str, number: str = "序号", most: int = SHEET_ROWS) -> None:
    """A numbered CSV for spreadsheets: one file with a byte-order mark, of at most as many rows as a sheet has (an error beyond)."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; write csv_lines with Spark instead")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as file:
        for row in csv_lines(rows, order, number).orderBy("place").toLocalIterator():
            file.write(row.line + "\n")

"""RIS, EndNote and BibTeX files as DataFrames of records.

Two ways in: `read_ris` and the like, which let Spark's text reader split the
files at record ends and distribute them (any file system Spark can read), and
the formats "ris", "enw" and "bibtex" for spark.read.format after `register`,
which read one file a partition from any file system Arrow can open. Records
that stand in a text column are read by `records_of`.

Records are rows (file, ordinal, fields, raw): fields maps a tag to its
values in order, so a repeated tag needs no other type than a single one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, ordinal long, fields map<string,array<string>>, raw string"
_RIS_TAG = re.compile(r"^([A-Z][A-Z0-9])  -\s?(.*)$")
_ENW_TAG = re.compile(r"^(%[A-Za-z0-9@+#*!?~])\s+(.*)$")


def _add(fields: dict[str, list[str]], tag: str, value: str) -> None:
    fields.setdefault(tag, []).append(value)


def ris_records(text: str) -> Iterator[tuple[dict[str, list[str]], str]]:
    """(fields, raw) of each record: ER ends one, a last one without ER is kept, a byte-order mark is no text."""
    fields: dict[str, list[str]] = {}
    lines: list[str] = []
    for line in text.lstrip("﻿").splitlines():
        found = _RIS_TAG.match(line.rstrip())
        if found and found[1] == "ER":
            if fields:
                yield fields, "\n".join(lines)
            fields, lines = {}, []
            continue
        if found:
            _add(fields, found[1], found[2].strip())
        if line.strip():
            lines.append(line)
    if fields:
        yield fields, "\n".join(lines)


def enw_records(text: str) -> Iterator[tuple[dict[str, list[str]], str]]:
    """(fields, raw) of each record between empty lines; a line without a tag goes on the value before."""
    for block in re.split(r"\n[ \t]*\n", text.lstrip("﻿").replace("\r\n", "\n")):
        fields: dict[str, list[str]] = {}
        last = None
        for line in block.split("\n"):
            found = _ENW_TAG.match(line)
            if found:
                last = found[1]
                _add(fields, last, found[2].strip())
            elif last and line.strip():
                fields[last][-1] += " " + line.strip()
        if fields:
            yield fields, block.strip("\n")


def _balanced(text: str, start: int) -> int:
    """The place after the brace that closes the one at start; the end of the text if none does."""
    depth = 0
    for at in range(start, len(text)):
        depth += (text[at] == "{") - (text[at] == "}")
        if depth == 0:
            return at + 1
    return len(text)


def bibtex_entries(text: str) -> Iterator[tuple[dict[str, list[str]], str]]:
    """(fields, raw) of each entry, with its key and type as `key` and `type`; braces may nest to any depth."""
    at = 0
    while found := re.compile(r"@(\w+)\s*\{\s*([^,\s{}]+)\s*,").search(text, at):
        end = _balanced(text, text.index("{", found.start()))
        raw = text[found.start() : end]
        fields = {"type": [found[1].lower()], "key": [found[2]]}
        body, place = raw[found.end() - found.start() : -1 if raw.endswith("}") else None], 0
        while field := re.compile(r"([A-Za-z][\w-]*)\s*=\s*").search(body, place):
            place = field.end()
            if place < len(body) and body[place] == "{":
                stop = _balanced(body, place)
                value = body[place + 1 : stop - 1]
            elif place < len(body) and body[place] == '"':
                stop = body.find('"', place + 1) % (len(body) + 1) + 1
                value = body[place + 1 : stop - 1]
            else:
                stop = re.compile(r"[,\s]|$").search(body, place).start()
                value = body[place:stop]
            fields[field[1].lower()] = [" ".join(value.split())]
            place = stop
        yield fields, raw
        at = end


_PARSERS = {"ris": ris_records, "enw": enw_records, "bibtex": bibtex_entries}


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str) -> None:
        self.kind, self.path = kind, path

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.Directory:
            files = system.get_file_info(fs.FileSelector(path))
        else:
            folder, _, pattern = path.rpartition("/")
            files = [found] if found.is_file else [file for file in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if fnmatch(file.base_name, pattern)]
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        return [_File(scheme + file.path) for file in sorted(files, key=lambda file: file.path) if file.is_file]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # no file
            return
        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_stream(path) as file:
            text = file.read().decode("utf-8", errors="replace")
        for ordinal, (fields, raw) in enumerate(_PARSERS[self.kind](text)):
            yield partition.path, ordinal, fields, raw


class _Records(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.kind, self.options["path"])


class Ris(_Records):
    kind = "ris"


class Enw(_Records):
    kind = "enw"


class Bibtex(_Records):
    kind = "bibtex"


def register(spark: SparkSession) -> None:
    """Make the formats ris, enw and bibtex known to a session."""
    for source in (Ris, Enw, Bibtex):
        spark.dataSource.register(source)


def _chunks(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(file, ordinal, raw): text files cut at a separator, by splits. ordinal orders the parts of a file; it is not consecutive."""
    # a split has fewer parts than bytes, so its start plus a number within the task orders the parts of a file
    ordinal = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("file"), ordinal.alias("ordinal"), F.regexp_replace("value", r"^\x{feff}", "").alias("raw"))


def ris_fields(raw: Column | str) -> Column:
    """The fields of one RIS record in a text."""
    tag = r"(?md)^([A-Z][A-Z0-9])  -[ \t]?(.*)$"
    flat = F.regexp_replace(raw, "\r", "")
    pairs = F.arrays_zip(F.regexp_extract_all(flat, F.lit(tag), 1).alias("t"), F.regexp_extract_all(flat, F.lit(tag), 2).alias("v"))
    tags = F.array_distinct(F.regexp_extract_all(flat, F.lit(tag), 1))
    return F.map_from_arrays(tags, F.transform(tags, lambda t: F.transform(F.filter(pairs, lambda p: p["t"] == t), lambda p: F.trim(p["v"]))))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS records of any number of files of any size."""
    return _chunks(spark, path, "\nER  -").withColumn("fields", ris_fields("raw")).where(F.size("fields") > 0).select("file", "ordinal", "fields", "raw")


def records_of(docs: DataFrame, ident: str, text: str, kind: str) -> DataFrame:
    """(ident, n, fields, raw): the records that stand in the texts of a column, numbered from 0. kind is ris, enw or bibtex."""
    fields = {field.name: field.dataType for field in docs.select(ident).schema}
    schema = T.StructType([T.StructField(ident, fields[ident]), T.StructField("n", T.LongType()), *T.StructType.fromDDL(SCHEMA).fields[2:]])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(own, n, fields, raw) for own, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]) if text for n, (fields, raw) in enumerate(_PARSERS[kind](text))]
            yield pd.DataFrame(rows, columns=[ident, "n", "fields", "raw"])

    return docs.select(ident, text).mapInPandas(parse, schema)


def _parsed(chunks: DataFrame, kind: str, start: str = "") -> DataFrame:
    """Records within the parts of files; where a separator takes the first letters of a record with it, start puts them back."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = (text if not start or text.lstrip().startswith(start) else start + text for text in batch["raw"])
            rows = [(file, ordinal, fields, raw) for file, ordinal, text in zip(batch["file"], batch["ordinal"], texts) for fields, raw in _PARSERS[kind](text)]
            yield pd.DataFrame(rows, columns=["file", "ordinal", "fields", "raw"])

    return chunks.mapInPandas(parse, SCHEMA)


def read_enw(spark: SparkSession, path: str) -> DataFrame:
    """EndNote records of files, cut at empty lines (files with other line ends than \\n are read whole)."""
    return _parsed(_chunks(spark, path, "\n\n"), "enw")


def read_bibtex(spark: SparkSession, path: str, last_wins: bool = True) -> DataFrame:
    """Entries of BibTeX files, cut where a line starts with @; with last_wins only the last of each key in a file."""
    rows = _parsed(_chunks(spark, path, "\n@"), "bibtex", "@")
    if not last_wins:
        return rows
    key = F.col("fields")["key"][0]
    return rows.groupBy("file", key.alias("_key")).agg(F.max_by(F.struct("ordinal", "fields", "raw"), "ordinal").alias("r")).select("file", "r.*")


def value(tag: str, fields: Column | str = "fields") -> Column:
    """The first value of a tag, null if there is none."""
    return F.get(F.try_element_at(F.col(fields) if isinstance(fields, str) else fields, F.lit(tag)), F.lit(0))


def values(tag: str, fields: Column | str = "fields") -> Column:
    return F.coalesce(F.try_element_at(F.col(fields) if isinstance(fields, str) else fields, F.lit(tag)), F.array().cast("array<string>"))


def direction_of_file(file: Column | str = "file") -> Column:
    """The number before - or _ at the start of a file name; null if there is none."""
    return F.nullif(F.regexp_extract(F.col(file) if isinstance(file, str) else file, r"(?:^|[/\\])(\d+)[_-][^/\\]*$", 1), F.lit("")).cast("int")


def count_by_direction(records: DataFrame) -> DataFrame:
    """(direction, is_cnki, n): records of RIS files by the number and suffix of their names."""
    return records.groupBy(direction_of_file().alias("direction"), F.col("file").contains("_cnki").alias("is_cnki")).agg(F.count(F.lit(1)).alias("n"))


def screening_fields(records: DataFrame) -> DataFrame:
    """RIS records as the screening reads them: title, lead author, year, journal, ISSNs, abstract, keywords, DOI."""
    from folioscale.functions import text as X

    title = F.coalesce(value("TI"), value("T1"))
    journal = F.coalesce(*[F.nullif(X.strip(value(tag)), F.lit("")) for tag in ("T2", "J2", "JO", "JF")])
    return records.select(
        "file", "ordinal", title.alias("title"), X.lead_author(value("AU")).alias("surname"), F.nullif(F.regexp_extract(F.coalesce(value("PY"), F.lit("")), r"(\d{4})", 1), F.lit("")).cast("int").alias("year"),
        journal.alias("journal"), X.issn_list(values("SN")).alias("issns"), value("AB").alias("abstract"), values("KW").alias("keywords"), X.doi(F.coalesce(value("DO"), value("DI"))).alias("doi"),
    )

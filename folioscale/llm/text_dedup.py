"""Records that differ in layout only: one record each, with the number of copies.

Characters are composed (NFC) and case-folded; blanks and punctuation are
removed; fields that may change places are sorted. The canonical text is
hashed to 128 bits, with a second, independent hash of 64 bits as a check,
and counts and the smallest id are aggregated by hash, combining before the
shuffle. A hash under which two checks meet (their minimum and maximum
differ) is a collision, and its rows are grouped by both.

Defined results: a row with a null field, or with a field that holds neither
letter nor digit, takes no part; a group may have any size; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.runtime import attach_group, cut_lineage

_NOT_TEXT = re.compile(r"[\W_]+")
#: As above, but accents and vowel signs (of the categories M) stay: the blocks in which they lie.
_NOT_TEXT_MARKS = re.compile("(?:(?![\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u0900-\u0903\u093a-\u094f\u1ab0-\u1aff\u20d0-\u20f0])[\\W_])+")


def canonical(text: str) -> str:
    """Letters and digits of a text (with accents that do not compose), case-folded, in their order."""
    if text.isascii():
        return _NOT_TEXT.sub("", text.lower())
    return _NOT_TEXT_MARKS.sub("", unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()))


def _has_text(form: str) -> bool:
    return any(char.isalnum() for char in form)


def _md5(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def hashed(df: DataFrame, id_col: str, exact: list[str], texts: list[str], digest: Callable[[bytes], bytes] = _md5) -> DataFrame:
    """(id, digest, check) of the rows that take part; `exact` columns count as they are, `texts` may change places."""
    parts = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(name).cast("string").alias(f"exact_{i}") for i, name in enumerate(exact)], *[F.col(name).alias(f"text_{i}") for i, name in enumerate(texts)])
    for name in parts.columns[1:]:
        parts = parts.where(F.col(name).isNotNull())
    n = len(exact)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, checks = [], [], []
            columns = [column.to_pylist() for column in batch.columns]
            for row in zip(*columns):
                forms = [canonical(text) for text in row[1 + n :]]
                if all(map(_has_text, forms)):
                    key = "\x1f".join((*row[1 : 1 + n], *sorted(forms))).encode()
                    ids.append(row[0])
                    digests.append(digest(key))
                    checks.append(xxhash.xxh64_intdigest(key, 17) - 2**63)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(checks, pa.int64())], names=["id", "digest", "check"])

    return parts.mapInArrow(rows, "id long, digest binary, check long")


def _groups(records: DataFrame) -> DataFrame:
    """(digest, check, copies, keep_id): one row a record; digests under which two checks meet are split by check."""
    by_digest = records.groupBy("digest").agg(F.min("check").alias("check"), F.max("check").alias("last"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("keep_id"))
    by_digest = cut_lineage(by_digest)
    clean = by_digest.where(F.col("check") == F.col("last")).drop("last")
    colliding = by_digest.where("check <> last").select("digest")
    if not colliding.take(1):
        return clean
    split = records.join(colliding, "digest", "left_semi").groupBy("digest", "check").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("keep_id"))
    return clean.unionByName(split)


def collapse(df: DataFrame, id_col: str, exact: list[str], texts: list[str], digest: Callable[[bytes], bytes] = _md5) -> DataFrame:
    """(keep_id, copies): one row for each record, with how many rows of df hold it."""
    return _groups(hashed(df, id_col, exact, texts, digest)).select("keep_id", "copies")


def copies(df: DataFrame, id_col: str, exact: list[str], texts: list[str], digest: Callable[[bytes], bytes] = _md5) -> DataFrame:
    """(keep_id, copy_id): each row that is a copy, with the smallest id of its group."""
    records = cut_lineage(hashed(df, id_col, exact, texts, digest))
    several = _groups(records).where(F.col("copies") > 1)
    pairs = attach_group(records, several, ["digest", "check"], "copies")
    return pairs.where(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"))

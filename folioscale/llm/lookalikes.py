"""Text that looks the same brought to one form.

Words are compared by a weighted edit automaton that walks a trie of the
vocabulary: look-alike letters, widths, compositions and invisible characters
cost nothing, any other edit costs 1, and with the limit 0 a word reaches
exactly the spellings that read like it. Of these the canonical one is chosen
(one that has nothing odd, else one script before several, then the most
frequent). A word that reaches no other spelling is normalised by table. Words
are spread by what they read as, so that spellings that may reach each other
meet and no reading crowds a task; a task walks its words in order, in tries
of a few thousand. Only readings of an odd word are visited. Texts are read
once, for their keys and their words.

Defined results: null stays null; ordinary blanks are collapsed and trimmed;
unusual blanks count as blanks; accents, raised and lowered digits, case and
punctuation are kept, since a reader can see them. Rows that agree are given
as pairs, or as rows with the class they are in.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.llm.pairs import pairs_within
from folioscale.runtime import attach_group, cut_lineage

#: Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "ϲ": "c", "Ϲ": "C", "Ϳ": "J",
    # Armenian, and letters of phonetic alphabets
    "օ": "o", "Օ": "O", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "ɑ": "a", "ɡ": "g", "ꞑ": "n",
    # hyphens
    "‐": "-", "‑": "-",
}
#: Characters of no width that are not of the category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Blanks other than space, tab and line ends.
UNUSUAL_BLANKS = "  " + "".join(map(chr, range(0x2000, 0x200B))) + "    　\x85\x0b\x0c\x1c\x1d\x1e\x1f"
#: Compatibility forms of which a reader sees no difference (raised, lowered, circled and styled forms are seen).
_UNSEEN = ("<wide>", "<narrow>", "<compat>", "<noBreak>")


@cache
def units(char: str) -> str:
    """A character taken apart: width and ligatures undone, accents separate; invisible ones are empty."""
    if char in INVISIBLE or unicodedata.category(char) == "Cf":
        return ""
    form = unicodedata.decomposition(char)
    if form.startswith(_UNSEEN) and not form.endswith(" 0020") and " 0020 " not in form:
        return "".join(units(chr(int(code, 16))) for code in form.split()[1:])
    flat = unicodedata.normalize("NFD", char)
    return flat if flat == char else "".join(units(x) for x in flat)


@cache
def reads_as(unit: str) -> str:
    """The class of a unit: the Latin letter it looks like, or itself."""
    return LOOKALIKES.get(unit, unit)


def skeleton(text: str) -> str:
    """What a text reads as; texts that read the same have the same skeleton."""
    flat = unicodedata.normalize("NFD", "".join(units(char) for char in text))
    return unicodedata.normalize("NFC", "".join(reads_as(unit) for unit in flat))


def script(unit: str) -> str:
    """A coarse script name of a letter, empty for what belongs to none."""
    name = unicodedata.name(unit, "") if unit.isalpha() else ""
    return name.split(" ")[0].split("-")[0]


def _spelled(word: str) -> str:
    return unicodedata.normalize("NFD", "".join(units(char) for char in word))


class Trie:
    """Vocabulary words, walked by an edit automaton with costs."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for unit in _spelled(word):
            node = node.setdefault(unit, {})
        node.setdefault("", []).append(word)

    def reach(self, word: str, limit: float = 0.0, other: float = 1.0) -> dict[str, float]:
        """Words within the limit and the least cost of each. Look-alikes and ignorables are free, other edits cost `other`."""
        target = _spelled(word)
        found: dict[str, float] = {}
        seen: dict[tuple[int, int], float] = {}
        stack = [(self.root, 0, 0.0)]
        while stack:
            node, at, cost = stack.pop()
            if seen.get((id(node), at), limit + other) <= cost:
                continue
            seen[id(node), at] = cost
            if at == len(target):
                for end in node.get("", ()):
                    found[end] = min(cost, found.get(end, cost))
            elif cost + other <= limit:
                stack.append((node, at + 1, cost + other))
            for unit, child in node.items():
                if not unit:
                    continue
                if at < len(target):
                    step = 0.0 if reads_as(unit) == reads_as(target[at]) else other
                    if cost + step <= limit:
                        stack.append((child, at + 1, cost + step))
                if cost + other <= limit:
                    stack.append((child, at, cost + other))
        return found


def by_table(word: str) -> str:
    """A word without equals: invisible characters, widths and compositions undone; look-alikes only where scripts are mixed."""
    flat = _spelled(word)
    if len({script(unit) for unit in flat} - {""}) > 1:
        flat = "".join(reads_as(unit) for unit in flat)
    return unicodedata.normalize("NFC", "".join("-" if unit in "‐‑" else unit for unit in flat))


def choose(spellings: dict[str, int]) -> str:
    """The canonical one of spellings that read the same: nothing odd, one script, then frequency, then the smallest.

    At most one of them has nothing odd: its rows keep it without being looked up.
    """
    clean: dict[str, int] = {}
    for word, count in spellings.items():
        if not is_odd(word):
            return word
        form = unicodedata.normalize("NFC", _spelled(word))
        clean[form] = clean.get(form, 0) + count
    return min(clean, key=lambda form: (len({script(unit) for unit in form} - {""}) > 1, -clean[form], form))


@cache
def _punctuation() -> tuple[str, str]:
    """Punctuation and symbols of another width or form, and what they read as, one character each."""
    pairs = [(chr(code), units(chr(code))) for code in range(0x80, 0x10000) if unicodedata.category(chr(code))[0] in "PS"]
    pairs = [(char, form) for char, form in pairs if len(form) == 1 and form != char] + [("‐", "-"), ("‑", "-")]
    return "".join(char for char, _ in pairs), "".join(form for _, form in pairs)


@cache
def _unusual() -> re.Pattern:
    """All that may read like something else, punctuation aside."""
    codes = {ord(char) for char in LOOKALIKES} | {ord(char) for char in INVISIBLE}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        form = unicodedata.decomposition(char)
        if kind == "Cf" or kind[0] == "M" or form and " " not in form:
            codes.add(code)
        elif kind[0] in "LN" and form.startswith(_UNSEEN) and units(char) != char:
            codes.add(code)
    ranges: list[list[int]] = []
    for code in sorted(codes):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return re.compile("[" + "".join(f"{re.escape(chr(low))}-{re.escape(chr(high))}" for low, high in ranges) + "]")


@cache
def _even() -> dict[int, str]:
    """Punctuation of another width, and blanks, by code point."""
    source, target = _punctuation()
    return {ord(char): form for char, form in zip(source + UNUSUAL_BLANKS, target + " " * len(UNUSUAL_BLANKS))}


_ORDINARY = re.compile(r"[ \t\r\n]+")
_IDEOGRAPHS = "\u2e80-\u2fd5\u3400-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f"
#: A word is a run of characters other than blanks and ideographs; an ideograph, with its marks, is a word.
_WORDS = re.compile(f"\\s+|[{_IDEOGRAPHS}][\u0300-\u036f\ufe00-\ufe0f\u200b-\u200f\u2060-\u2064\ufeff\u00ad]*|[^\\s{_IDEOGRAPHS}]+")
#: Words other than ideographs: a usual ideograph matters only where an odd one may read like it, so it is counted in odd texts.
_RUNS = re.compile(f"[^\\s{_IDEOGRAPHS}]+")


def tidy(text: str) -> str:
    """Ordinary blanks collapsed and trimmed; the other characters as they are stored."""
    return _ORDINARY.sub(" ", text).strip(" ")


def plain(text: str) -> str:
    """The part of the normalisation that needs no words: punctuation of another width, and blanks."""
    return tidy(text if text.isascii() else text.translate(_even()))


def is_odd(text: str) -> bool:
    """Whether a text has a letter, mark or invisible character that may read like another."""
    return not text.isascii() and _unusual().search(text) is not None


#: Words that a trie holds before the next reading starts another, and words a task counts before it passes them on.
TRIE_WORDS, HELD = 5_000, 200_000
_READ = "id long, stored string, key string, odd boolean, texts array<string>, word string, reading string, n long"


def _read(df: DataFrame, id_col: str, fields: list[str], with_text: bool) -> DataFrame:
    """Rows (id, stored, key, odd, texts) of the texts, and rows (word, reading, n) of the vocabulary, counted within partitions.

    stored hashes the stored texts; usual rows have the key (or with_text,
    texts), odd rows texts only. With a null field, key and stored are null.
    reading is what an odd word reads as; usual words read as they are.
    """

    def table(columns: dict[str, list], size: int) -> pa.RecordBatch:
        types = {"id": pa.int64(), "stored": pa.string(), "key": pa.string(), "odd": pa.bool_(), "texts": pa.list_(pa.string()), "word": pa.string(), "reading": pa.string(), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * size), kind) for name, kind in types.items()], names=list(types))

    def counted(words: Counter) -> pa.RecordBatch:
        words.pop(" ", None)
        return table({"word": list(words), "reading": [skeleton(word) if is_odd(word) else None for word in words], "n": list(words.values())}, len(words))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            stored, keys, odd, texts = [], [], [], []
            for row in zip(*columns[1:]):
                whole, strange = None not in row, False
                even = []
                for text in row:
                    text = text if text is None else plain(text)
                    even.append(text)
                    if text:
                        unusual = is_odd(text)
                        strange = strange or unusual
                        words.update((_WORDS if unusual else _RUNS).findall(text))
                odd.append(strange)
                stored.append(_digest([tidy(text) for text in row]) if whole else None)
                keys.append(_digest(even) if whole and not strange else None)
                texts.append(even if strange or with_text else None)
            yield table({"id": columns[0], "stored": stored, "key": keys, "odd": odd, "texts": texts}, len(odd))
            if len(words) > HELD:
                yield counted(words)
                words = Counter()
        yield counted(words)

    named = [F.col(name).alias(f"text_{i}") for i, name in enumerate(fields)]
    return cut_lineage(df.select(F.col(id_col).cast("long").alias("id"), *named).mapInArrow(rows, _READ))


def spellings(words: DataFrame) -> DataFrame:
    """(word, canonical) of the odd words of a vocabulary (word, reading, n): by trie, else by table."""
    counts = cut_lineage(words.groupBy("word", "reading").agg(F.sum("n").alias("n")).withColumn("as", F.coalesce("reading", "word")))
    pool = counts.join(counts.where("reading is not null").select("as").distinct(), "as", "left_semi")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        last = None
        for batch in batches:
            out: list[tuple[str, str]] = []
            for reading, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                if reading != last and len(held) >= TRIE_WORDS:
                    out += canonical(held)
                    held = {}
                held[word], last = n, reading
            yield _pairs(out)
        yield _pairs(canonical(held))

    return pool.select("as", "word", "n").repartition("as").sortWithinPartitions("as").mapInArrow(settle, "word string, canonical string")


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    words, forms = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(forms, pa.string())], names=["word", "canonical"])


def canonical(counts: dict[str, int]) -> list[tuple[str, str]]:
    """(word, canonical spelling) of the odd ones among some words."""
    trie = Trie()
    for word in counts:
        trie.add(word)
    out = []
    for word in counts:
        if is_odd(word):
            same = trie.reach(word)
            out.append((word, choose({x: counts[x] for x in same}) if len(same) > 1 else by_table(word)))
    return out


def _digest(parts: list[str]) -> str:
    return hashlib.md5("\x1f".join(parts).encode(), usedforsecurity=False).hexdigest()


def _mended(read: DataFrame, fields: list[str]) -> DataFrame:
    """(id, stored, texts): the odd rows of _read with their texts in consistent form."""
    odd = read.where("odd").select("id", "stored", "texts")
    chosen = cut_lineage(spellings(read.where("word is not null").select("word", "reading", "n")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, field, at, word) for i, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for field, text in enumerate(texts) if text is not None for at, word in enumerate(_WORDS.findall(text) or [""])]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], names=["id", "field", "at", "word"])

    parts = odd.select("id", "texts").mapInArrow(words, "id long, field int, at int, word string")
    joined = parts.join(chosen, "word", "left").groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical", "word").alias("w")))).alias("ws"))
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.col("ws.w"), ""), r"[ \t\r\n]+", " "), "^ | $", "")
    one = joined.select("id", "field", text.alias("text")).groupBy("id").agg(*[F.max(F.when(F.col("field") == i, F.col("text"))).alias(f"t{i}") for i in range(len(fields))])
    return odd.drop("texts").join(one, "id").select("id", "stored", F.array(*[f"t{i}" for i in range(len(fields))]).alias("texts"))


def consistent(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, <fields>): each field in its consistent form."""
    read = _read(df, id_col, fields, True)
    all_rows = _mended(read, fields).unionByName(read.where("not odd").select("id", "stored", "texts"))
    return all_rows.select("id", *[F.col("texts")[i].alias(name) for i, name in enumerate(fields)])


def alike(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, key, stored): rows whose fields (none null) read like those of another row and differ in a stored text from some row of their key."""
    read = _read(df, id_col, fields, False)
    odd = _mended(read.where("stored is not null or word is not null"), fields).select("id", F.md5(F.array_join("texts", "\x1f")).alias("key"), "stored")
    odd = cut_lineage(odd)
    keyed = read.where("stored is not null and not odd").select("id", "key", "stored").unionByName(odd)
    mixed = keyed.groupBy("key").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low <> high").select("key")
    return cut_lineage(keyed.join(mixed, "key", "left_semi"))


def alike_pairs(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id_a, id_b): rows whose fields (none null) all read the same while a stored text differs."""
    pairs = pairs_within(alike(df, id_col, fields), "key", "id", "stored").where("stored_a <> stored_b")
    return pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def alike_classes(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, class, members, spellings): the rows of alike_pairs, each with the smallest id, the rows and the stored spellings of its class."""
    rows = alike(df, id_col, fields)
    forms = rows.groupBy("key", "stored").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("members"))
    classes = forms.groupBy("key").agg(F.min("class").alias("class"), F.sum("members").alias("members"), F.count(F.lit(1)).alias("spellings"))
    return attach_group(rows.select("id", "key"), classes, ["key"], "members").select("id", "class", "members", "spellings")

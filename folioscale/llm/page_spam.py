"""Pages of stuffed keywords, tags, menus, product lists and links.

Exact corpus counts of words and of neighbouring words give the pointwise
mutual information (PMI) of every pair of neighbours. Links, markup and hash
signs count as words. A text is cut into units: sentences, lines, and runs of
short lines, which are lists. A unit shows spam if many of its neighbours
either meet by chance only (PMI about 0: word salad, entries in random order)
or are collocations (high PMI) that the text repeats; if its mean PMI is far
above that of the corpus, as in texts of nothing but set phrases; or if it is
a long run of words without coherence. Units that read like sentences (enough
different words, and small words between them), references, and short lines
with a label are not spam unless they are such long runs. A page is spam if
more than half of its characters are in units that show it.

Counts cover all documents and are exact: pairs are combined within
partitions and summed by a shuffle. Only texts whose units could make up half
a page are joined with the counts, key by key, keys of many texts apart, so
nothing of the corpus comes to the driver or is broadcast but the mean PMI.

Defined results: null, empty and blank texts are not spam; a text without
letters is spam only if it is made of links; words are hashed to 63 bits, a
collision of which is taken as impossible.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.runtime import attach_group, cut_lineage

#: Neighbours with a PMI below this meet no more often than by chance (a third of a nat is noise), those above are collocations.
CHANCE, COLLOCATION = 1.0, 2.0
#: A collocation is repeated if a text has it this often.
REPEATED = 3
#: Least share of repeated collocations, neighbours by chance counting twice, that shows spam.
ABNORMAL = 0.18
#: Mean PMI above that of the corpus, in nats, that shows set phrases only; the least words to tell it by.
EXCESS, EXCESS_WORDS = 1.2, 12
#: Words, and share of neighbours by chance, of a run that is no sentence whatever words it has.
SALAD_WORDS, SALAD = 64, 0.14
#: Least share of small words in a sentence, by script, and of different content words (neighbours, in Chinese) among them.
GLUE = {"latin": 0.10, "ideographs": 0.075}
DIFFERENT = {"latin": 0.6, "ideographs": 0.75}
#: Words of a unit that may be a menu entry, a product or a search phrase.
SHORT = 12
#: A page is spam above this share of spam characters.
HALF = 0.5

#: Small words of English and Chinese.
SMALL_WORDS = frozenset(
    "the a an of and or to in on at by for from with as is are was were be been it its this that these those we our they their he she which who whom whose what when where while than then but not no nor so if because although though there here has have had do does did can could may might must should would will shall about into over after before between only also both each how why such more most very your you i my me us them one two some any other"
    " 的 了 是 在 与 和 把 被 对 为 而 以 及 我 这 那 其 此 也 都 就 还 又 但 若 则 且 或 从 到 于 之 者 所 并 未 不 无 可 能 应 将 已 有 由 向 让 使 更 很 较 只 仅 均 各 该 几 如 因".split()
)
_URL = re.compile(r"""(?:https?://|www\.)[^\s"'<>)\]，。；、]+""")
_MARKUP = re.compile(r"<[^<>]{1,400}>")
#: What stands for a link and for markup among the words.
LINK, MARK = "\x01", "\x02"
_HAN = re.compile("[㐀-鿿]")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*|[\x01\x02]|#(?=[^\s#])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-z])|(?<=[。！？])")
_SENTENCE_END = re.compile(r"[.。!！?？][\"'”’)）\]}*_]*\s*$")
_LABEL = re.compile(r"^\s*(?:[-*•]\s*)?[\w -]{1,16}\s*[:：]|^\s*(?:#{1,6}\s|\\(?:sub)*section|[A-Z][A-Z0-9]  - )")
_REFERENCE = re.compile(r"^\s*(?:\[\d+\]|\d+[.)]|[-*•]|\\bibitem\S*)?\s*\S.{0,200}[(（]?(?:19|20)\d\d[a-z]?[)）]?[.,，。;；:].*(?:doi|\d+\s*[(（]\d+[)）]|pp?\.|\d+[-–]\d+)", re.I)


def words_of(text: str) -> list[str]:
    """The words (ideographs) of a text, with a word each for links, markup and hash signs."""
    text = text.lower().replace(LINK, " ").replace(MARK, " ")
    if "://" in text or "www." in text:
        text = _URL.sub(LINK, text)
    if "<" in text:
        text = _MARKUP.sub(MARK, text)
    return _TOKEN.findall(text)


class Ids(dict):
    """Word to hash (even, so that pairs can be odd), remembered up to a bound."""

    def trim(self, most: int = 500_000) -> None:
        if len(self) > most:
            self.clear()

    def __missing__(self, word: str) -> int:
        self[word] = value = word_key(word)
        return value


def word_key(word: str) -> int:
    return (xxhash.xxh3_64_intdigest(word) >> 1) & ~1


def pair_keys(ids: np.ndarray) -> np.ndarray:
    """Odd hashes of neighbours."""
    left, right = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(1)) | np.uint64(1)).astype(np.int64)


class Unit:
    """A sentence, a line, or a run of short lines; what is known of its words is found out when first asked for."""

    __slots__ = ("_length", "_sentence", "lines", "size", "text", "words")

    def __init__(self, text: str, words: list[str], lines: int = 1, length: float | None = None) -> None:
        self.text, self.words, self.lines, self.size = text, words, lines, len(text)
        self._length, self._sentence = length, None

    @property
    def length(self) -> float:
        """Words, ideographs counting half, since a word of Chinese has about two."""
        if self._length is None:
            self._length = len(self.words) - _ideographs(self.text, self.words) / 2
        return self._length

    @property
    def sentence(self) -> bool:
        """Whether its words read like a sentence, a reference or a labelled line."""
        if self._sentence is None:
            self._sentence = len(self.words) > 1 and reads_like_sentence(self.text, self.words, self.length, self.lines)
        return self._sentence

    @property
    def link(self) -> bool:
        return self.words == [LINK]

    @property
    def long(self) -> bool:
        return len(self.words) > SALAD_WORDS and self.length > SALAD_WORDS

    def open(self) -> bool:
        """Whether its neighbours may show that it is spam."""
        return self.link or len(self.words) > 1 and (self.long or not self.sentence)


def _ideographs(text: str, words: list[str]) -> int:
    if text.isascii():
        return 0
    return len(_HAN.findall("".join(words) if LINK in words or MARK in words else text))


def units_of(text: str) -> list[Unit]:
    out: list[Unit] = []
    lines: list[tuple[str, list[str], float]] = []

    def end_list() -> None:
        if lines:
            texts, words, lengths = zip(*lines)
            out.append(Unit("\n".join(texts), [word for own in words for word in own], len(lines), sum(lengths)))
            lines.clear()

    for line in text.split("\n"):
        for part in map(str.strip, _SENTENCE.split(line) if len(line) > 40 else [line]):
            if not part:
                continue
            words = words_of(part)
            length = None
            if len(words) < 2 * SHORT:
                length = len(words) - _ideographs(part, words) / 2
                if length < SHORT and not _SENTENCE_END.search(part) and (LINK in words or "#" in words or not _LABEL.match(part)):
                    lines.append((part, words, length))
                    continue
            end_list()
            out.append(Unit(part, words, 1, length))
    end_list()
    return out


def reads_like_sentence(text: str, words: list[str], length: float, lines: int) -> bool:
    """Whether a unit is a sentence, a reference or a short line with a label, going by its words only."""
    links = words.count(LINK)
    if lines == 1 and not links and length < SHORT and (_LABEL.match(text) or _SENTENCE_END.search(text)):
        return True
    if lines == 1 and links == 1 and _REFERENCE.search(text):
        return True
    distinct = set(words)
    small = sum(map(SMALL_WORDS.__contains__, words))
    if length < 0.75 * len(words):  # more than half ideographs
        return small >= GLUE["ideographs"] * len(words) and len(set(zip(words, words[1:]))) > DIFFERENT["ideographs"] * (len(words) - 1)
    return small >= GLUE["latin"] * len(words) and len(distinct - SMALL_WORDS) > DIFFERENT["latin"] * (len(words) - small)


class Page:
    """A text cut into units, its words as hashes."""

    def __init__(self, text: str, ids: Ids) -> None:
        self.units = units_of(text)
        self.text, self.ids = text, np.array([ids[word] for unit in self.units for word in unit.words], dtype=np.int64)
        self.pairs = pair_keys(self.ids) if len(self.ids) > 1 else np.zeros(0, np.int64)
        self.size = sum(unit.size for unit in self.units)

    def doubtful(self) -> bool:
        """Whether the units that may be spam make up more than half of the page; the largest are looked at first."""
        rest = (1 - HALF) * self.size
        for unit in sorted(self.units, key=lambda unit: -unit.size):
            if not unit.open():
                rest -= unit.size
                if rest <= 0:
                    return False
        return self.size > 0

    def keys(self) -> np.ndarray:
        return np.unique(np.concatenate([self.ids, self.pairs]))

    def scores(self, keys: np.ndarray, counts: np.ndarray, corpus: Corpus) -> tuple[float, float, float]:
        """(share of spam, mean PMI, share of repeated collocations); keys are sorted."""
        if not self.size:
            return 0.0, 0.0, 0.0
        if len(self.pairs):
            own = counts[np.searchsorted(keys, self.ids)]
            pmi = corpus.pmi(counts[np.searchsorted(keys, self.pairs)], own[:-1], own[1:])
        else:
            pmi = np.zeros(0)
        _, inverse, times = np.unique(self.pairs, return_inverse=True, return_counts=True)
        repeated = (times[inverse] >= REPEATED) & (pmi >= COLLOCATION)
        spam, at = 0, 0
        for unit in self.units:
            low, high = at, at + len(unit.words) - 1
            at += len(unit.words)
            if unit.link or len(unit.words) > 1 and is_spam(unit, pmi[low:high], repeated[low:high], corpus.mean):
                spam += unit.size
        return spam / self.size, float(pmi.mean()) if len(pmi) else 0.0, float(repeated.mean()) if len(pmi) else 0.0


def is_spam(unit: Unit, pmi: np.ndarray, repeated: np.ndarray, mean: float) -> bool:
    """Whether the neighbours of a unit's words are those of salad, repeated collocations or set phrases."""
    chance = float((pmi < CHANCE).mean())
    if unit.long and chance >= SALAD:
        return True
    return not unit.sentence and (2 * chance + float(repeated.mean()) >= ABNORMAL or len(unit.words) >= EXCESS_WORDS and float(pmi.mean()) >= mean + EXCESS)


@dataclass
class Corpus:
    """Numbers of words and of neighbours in the corpus, and the mean PMI of its neighbours."""

    words: int
    pairs: int
    mean: float

    def pmi(self, both: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """PMI, discounted for rare pairs and words."""
        least = np.minimum(left, right)
        return np.log(both.astype(float) * self.words / self.pairs * self.words / left / right) + np.log(both / (both + 1.0) * least / (least + 1.0))


def spam_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, spam_share) of the documents that may be spam, with full (doc_id, spam_share, mean_pmi, repeated) of all."""
    pages = documents.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # one pass over the texts: rows (key, n) of words and pairs, and rows (key, doc_id, text) of doubtful pages, numbered by key
    read = cut_lineage(pages.mapInArrow(lambda batches: _read(batches, full), "key long, n long, doc_id long, text string"))
    counts = cut_lineage(read.where("n is not null").groupBy("key").agg(F.sum("n").alias("n")))
    corpus = corpus_of(counts)
    doubtful = read.where("n is null").select(F.col("key").alias("page"), "doc_id", "text")
    needed = doubtful.select("page", "text").mapInArrow(_keys, "page long, key long")
    known = needed.groupBy("key").agg(F.count(F.lit(1)).alias("pages")).join(counts, "key")
    own = attach_group(needed, known, ["key"], "pages").groupBy("page").agg(F.collect_list(F.struct("key", "n")).alias("known"))
    both = doubtful.join(own, "page", "left").select("doc_id", "text", "known")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids()
        for batch in batches:
            rows = []
            for doc, page, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                table = found.values if found.is_valid else None
                keys = table.field(0).to_numpy(zero_copy_only=False) if table is not None else np.zeros(0, np.int64)
                n = table.field(1).to_numpy(zero_copy_only=False) if table is not None else np.zeros(0, np.int64)
                order = np.argsort(keys)
                rows.append((doc, *Page(page, ids).scores(keys[order], n[order], corpus)))
                ids.trim()
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(column, pa.float64()) for column in columns[1:]]], names=["doc_id", "spam_share", "mean_pmi", "repeated"])

    scored = both.mapInArrow(score, "doc_id long, spam_share double, mean_pmi double, repeated double")
    return scored if full else scored.select("doc_id", "spam_share")


def corpus_of(counts: DataFrame) -> Corpus:
    """The sums over counts (key, n): words have even keys, neighbours odd ones. The mean PMI is twice the entropy of words less that of neighbours."""
    sums = {row.odd: row for row in counts.groupBy((F.col("key") % 2 != 0).alias("odd")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.ln("n")).alias("s")).collect()}
    entropy = lambda row: math.log(row.n) - row.s / row.n
    words, pairs = sums.get(False), sums.get(True)
    return Corpus(words.n if words else 1, pairs.n if pairs else 1, round(2 * entropy(words) - entropy(pairs), 6) if words and pairs else 0.0)


#: Distinct words and pairs that a task holds before it passes their counts on.
HELD = 2_000_000


def _read(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    ids = Ids()
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(keys, n, docs, texts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(docs, pa.int64()), pa.array(texts, pa.string())], names=["key", "n", "doc_id", "text"])

    def counted() -> pa.RecordBatch:
        nothing = [None] * len(keys)
        return rows(keys, counts, nothing, nothing)

    for batch in batches:
        found, kept = [], []
        for number, doc, text in zip(*(column.to_pylist() for column in batch.columns)):
            page = Page(text or "", ids)
            found += [page.ids, page.pairs]
            if full or page.doubtful():
                kept.append((number, doc, text or ""))
        ids.trim()
        if kept:
            numbers, docs, texts = zip(*kept)
            yield rows(numbers, [None] * len(numbers), docs, texts)
        if found:
            own, n = np.unique(np.concatenate(found), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        if len(keys) > HELD:
            yield counted()
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys):
        yield counted()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = Ids()
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        keys = [Page(text, ids).keys() for text in batch.column(1).to_pylist()]
        ids.trim()
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, list(map(len, keys)))), pa.array(np.concatenate(keys))], names=["page", "key"])

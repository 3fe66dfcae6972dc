"""Held-out test items inside a training corpus.

One Aho-Corasick automaton holds short runs of words (ideographs) of all test
items, without case, blanks and punctuation. Each document is brought to the
same form and scanned once; the hits of an item are chained where they run on
in both texts, small gaps being single words added, dropped or changed. A
chain is a leak if it spans about 20 words (40 ideographs) of the item, the
words next to a changed one at its ends included, and hits cover most of the
stretch between its ends (of a stretch with many changes, only covered words
count). Items share wordings, so a chain over a passage
that another item explains better is not a leak. Sentences that several items
share (instructions) are not part of any item's own text. Offsets are mapped
to the original text.

Defined results: null and empty texts have no leaks; equal items leak
together; an item shorter than the least span must be there nearly whole; an
item without letters or digits never leaks.

Bounds: an automaton holds items of at most BLOCK_CHARS characters (or one
longer item). More items are cut into blocks, each with an automaton and a
scan of its own; what items share and which item explains a passage best is
found over all of them, so the blocks do not change the result. Items are
collected block by block, the corpus never. A run that many items share costs
a hit for each of them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.runtime import cut_lineage, salt

#: Characters of the items of one automaton.
BLOCK_CHARS = 4_000_000
#: Least span of a leak in words of the item; an ideograph counts half a word. Half a word may be lost at the ends of a passage.
LEAST_WORDS = 19.5
#: Least share of a span that hits cover, and the share from which its changed words count as words of the item.
LEAST_COVER, FEW_CHANGES = 0.72, 0.85
#: Letters and digits that may be added, dropped or changed between two hits, and by which the two texts may shift there.
MAX_GAP, MAX_SHIFT = 40, 20
#: Words, or ideographs, of a run.
RUN_WORDS, RUN_IDEOGRAPHS = 3, 6
#: Words that may be added at either end of a chain: a changed one and less than a run.
BESIDE = 3
#: Share of a chain that another item's chain must overlap to compete with it, and the share of its cover at which both stand.
OVERLAP, EQUAL = 0.5, 0.995

_IDEOGRAPH = "㐀-鿿豈-﫿"
_TOKEN = re.compile(f"[{_IDEOGRAPH}]|[^\\W_{_IDEOGRAPH}]+")
_GAP = re.compile(r"[\W_]+")
_WIDE = re.compile("[！-～]")
_TO_NARROW = {code: code - 0xFEE0 for code in range(0xFF01, 0xFF5F)}
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？：])|\n+")


def _even(text: str) -> str:
    text = text.translate(_TO_NARROW) if _WIDE.search(text) else text
    return text.lower()


def compact(text: str) -> str:
    """Letters and digits only, narrow and in lower case."""
    return _GAP.sub("", _even(text))


def offsets(text: str) -> list[int]:
    """For each character of compact(text), its place in text."""
    return [at for at, char in enumerate(text) for low in _even(char) if not _GAP.match(low)]


@dataclass
class Patterns:
    """Runs of words and where in which items they stand; per item its own text, where its words start and how much they count."""

    runs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    starts: list[list[int]] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)


def patterns(items: list[tuple[int, list[tuple[str, bool]]]]) -> Patterns:
    """The runs of items (id, sentences), a sentence being (text, whether it is the item's own)."""
    out = Patterns()
    runs: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for number, (item, sentences) in enumerate(items):
        starts, weights, text = [], [], ""
        for own, part in groupby(sentences, key=lambda sentence: sentence[1]):
            if own:
                tokens = _TOKEN.findall(_even(" ".join(sentence for sentence, _ in part)))
                first = len(starts)
                for token in tokens:
                    starts.append(len(text))
                    weights.append(0.5 if re.match(f"[{_IDEOGRAPH}]", token) else 1.0)
                    text += token
                for i in range(len(tokens)):
                    long = RUN_IDEOGRAPHS if weights[first + i] < 1 else RUN_WORDS
                    if i + long <= len(tokens):
                        runs["".join(tokens[i : i + long])].append((number, starts[first + i]))
            text += " " * (MAX_GAP + MAX_SHIFT + 1)  # what is left out breaks a chain
        out.texts.append(text)
        out.starts.append(starts)
        out.weights.append(weights)
        out.ids.append(item)
    out.runs = dict(runs)
    return out


def own_sentences(items: DataFrame) -> DataFrame:
    """(id, sentences, chars) of items (id, text): sentences array of (at, sentence, own), own if no different item has it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [(part, compact(part)) for part in _SENTENCE.split(text)]
                whole = "".join(form for _, form in parts)
                out += [(item, at, part, form, whole) for at, (part, form) in enumerate(parts) if form]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(list(zip(*out)) or [()] * 5, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["id", "at", "sentence", "form", "whole"])

    parts = items.mapInArrow(cut, "id long, at int, sentence string, form string, whole string").withColumns({"form": F.md5("form"), "whole": F.md5("whole")})
    shared = parts.select("form", "whole").distinct().groupBy("form").agg((F.count(F.lit(1)) < 2).alias("own"))
    flagged = parts.join(shared, "form").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "sentence", "own"))).alias("sentences"))
    return flagged.withColumn("chars", F.aggregate("sentences", F.lit(0).cast("long"), lambda n, x: n + F.length(x["sentence"])))


@dataclass
class Chain:
    item: int
    start: int
    end: int
    words: float
    cover: int
    spans: list[tuple[int, int]]

    def covered(self, low: int, high: int) -> int:
        return sum(max(0, min(end, high) - max(start, low)) for start, end in self.spans)


def _chains(item: int, hits: list[tuple[int, int, int]], page: str, known: Patterns) -> Iterator[Chain]:
    """The best chains of hits (place in document, place in item, length), one after the other without overlap."""
    starts, weights = known.starts[item], known.weights[item]
    total = sum(weights)
    least = min(LEAST_WORDS, 0.9 * total)
    hits = sorted(hits)
    while hits:
        score, before = [0] * len(hits), [-1] * len(hits)
        for j, (at, of, long) in enumerate(hits):
            score[j] = long
            for i in range(j - 1, -1, -1):
                at_i, of_i, long_i = hits[i]
                if at - at_i > MAX_GAP + long_i:
                    break
                if at_i < at and of_i < of and of - of_i <= MAX_GAP + long_i and abs((at - of) - (at_i - of_i)) <= MAX_SHIFT:
                    more = min(at + long - at_i - long_i, of + long - of_i - long_i, long)
                    if score[i] + more > score[j]:
                        score[j], before[j] = score[i] + more, i
        # the best chain, then the next as long as the ones taken leave it whole; else the rest is chained anew
        taken: list[tuple[int, int]] = []
        for end in sorted(range(len(hits)), key=lambda j: (-score[j], j)):
            if _meets(taken, hits[end][0], hits[end][0] + hits[end][2]):
                continue
            path, j = [], end
            while j >= 0:
                path.append(hits[j])
                j = before[j]
            path.reverse()
            low, high = path[0][1], path[-1][1] + path[-1][2]
            first, last = path[0][0], path[-1][0] + path[-1][2]
            if _meets(taken, first, last):
                break
            words = sum(weights[bisect_left(starts, low) : bisect_left(starts, high)])
            if words + 2 * BESIDE < least or not total:
                return
            words += _beside(item, low, high, page[max(0, first - MAX_GAP) : first], page[last : last + MAX_GAP], known)
            spans: list[tuple[int, int]] = []
            for at, _, long in path:
                if spans and at <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], at + long))
                else:
                    spans.append((at, at + long))
            cover = min(score[end], sum(b - a for a, b in spans))
            share = cover / max(high - low, last - first)
            if share >= LEAST_COVER and (words if share >= FEW_CHANGES else words * share) >= least:
                yield Chain(item, first, last, words, cover, spans)
            insort(taken, (first, last))
        hits = [hit for hit in hits if not _meets(taken, hit[0], hit[0] + hit[2])]


def _meets(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a stretch overlaps one of the sorted, disjoint stretches taken."""
    at = bisect_left(taken, (end,))
    return at > 0 and taken[at - 1][1] > start


def _beside(item: int, low: int, high: int, before: str, after: str, known: Patterns) -> float:
    """Words of the item at both ends of a chain of which one is changed and the others, too few for a run, are there."""
    text, starts, weights = known.texts[item], known.starts[item], known.weights[item]
    found = 0.0
    for step, at, page in ((1, bisect_left(starts, high), after), (-1, bisect_left(starts, low) - 1, before)):
        if not 0 <= at < len(starts):
            continue
        run = (RUN_IDEOGRAPHS if weights[at] < 1 else RUN_WORDS) - 1
        for n in range(run, 0, -1):
            words = sorted(range(at + step, at + step * (n + 1), step))
            if words[0] < 0 or words[-1] >= len(starts):
                continue
            start, end = starts[words[0]], starts[words[-1] + 1] if words[-1] + 1 < len(starts) else len(text.rstrip())
            piece = text[start:end]
            if " " not in piece and piece in page:
                found += weights[at] + sum(weights[i] for i in words)
                break
    return found


def find(text: str, automaton, known: Patterns) -> list[Chain]:
    """The chains of all items in one text, with places in its compact form."""
    hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    page = compact(text)
    for end, (long, places) in automaton.iter(page):
        for item, of in places:
            hits[item].append((end + 1 - long, of, long))
    return [chain for item, own in hits.items() for chain in _chains(item, own, page, known)]


def best_explained(chains: list[Chain]) -> list[Chain]:
    """The chains of one text over whose passages no other item's chain covers more."""
    kept: list[Chain] = []
    starts: list[tuple[int, int]] = []
    longest = 0
    for chain in sorted(chains, key=lambda c: (-c.cover, c.item, c.start)):
        # only chains that overlap can explain the passage better
        for _, number in starts[bisect_left(starts, (chain.start - longest,)) : bisect_left(starts, (chain.end,))]:
            other = kept[number]
            low, high = max(chain.start, other.start), min(chain.end, other.end)
            if other.item != chain.item and high - low > OVERLAP * (chain.end - chain.start) and chain.covered(low, high) < EQUAL * other.covered(low, high):
                break
        else:
            insort(starts, (chain.start, len(kept)))
            longest = max(longest, chain.end - chain.start)
            kept.append(chain)
    return kept


def automaton_of(known: Patterns):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for run, places in known.runs.items():
        automaton.add_word(run, (len(run), places))
    automaton.make_automaton()
    return automaton


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, words, cover): each stretch of an item in a document, places in the original text."""
    spark = documents.sparkSession
    wanted = cut_lineage(own_sentences(items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())))
    blocks = -(-(wanted.agg(F.sum("chars")).first()[0] or 0) // block_chars) or 1
    pages = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    found = None
    for block in range(blocks):
        rows = wanted.where(salt("id", blocks) == block).orderBy("id").select("id", "sentences").collect()
        known = spark.sparkContext.broadcast(patterns([(row.id, [(x.sentence, x.own) for x in row.sentences]) for row in rows]))

        def scan(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            ours = known.value
            if not ours.runs:
                return
            automaton = automaton_of(ours)
            for batch in batches:
                out: list[tuple] = []
                for doc, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    chains = find(page, automaton, ours)
                    if blocks == 1:
                        chains = best_explained(chains)
                    if chains:
                        places, digest = offsets(page), hashlib.md5(page.encode(), usedforsecurity=False).hexdigest()
                        out += [(doc, ours.ids[c.item], places[c.start], places[c.end - 1] + 1, c.words, c.cover, digest, c.start, c.end, [x for span in c.spans for x in span]) for c in chains]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), _TYPES)], names=_NAMES)

        part = pages.mapInArrow(scan, "doc_id long, item_id long, start long, end long, words double, cover long, digest string, first long, last long, spans array<long>")
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        # the chains of one text, which are as many as it has passages
        found = found.groupBy("digest", "doc_id").applyInPandas(_explained, found.schema)
    return found.select(*_NAMES[:6])


def _explained(rows: pd.DataFrame) -> pd.DataFrame:
    chains = [Chain(int(item), int(first), int(last), float(words), int(cover), list(zip(spans[::2], spans[1::2]))) for item, first, last, words, cover, spans in zip(rows["item_id"], rows["first"], rows["last"], rows["words"], rows["cover"], rows["spans"])]
    number = {id(chain): i for i, chain in enumerate(chains)}
    return rows.iloc[[number[id(chain)] for chain in best_explained(chains)]]


_NAMES = ["doc_id", "item_id", "start", "end", "words", "cover", "digest", "first", "last", "spans"]
_TYPES = [*[pa.int64()] * 4, pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

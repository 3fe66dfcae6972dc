"""Texts of several sources mixed to target shares of the total tokens.

A text may lie in several sources (copies). Texts are grouped by the pattern
of the listed sources that hold them, and only the token sums of patterns come
to the driver: of s sources at most 2^s - 1, whatever the number of texts
(8,191 of 13 sources). There a flow of least cost routes
tokens from patterns to the quotas of the sources: the k-th use of a pattern
costs k, so no text is repeated while another of its sources' texts is unused.
As a use costs the same wherever it goes, the flow is found by admitting
first uses, then second uses, and so on, each time to the maximum. Texts of a
pattern are then laid end to end in a seeded order, and a use goes to the
source whose stretch of the flow it begins in, so a quota is missed by less
than one text a pattern.

Defined results: without a total, the largest total is taken at which every
source that has any tokens reaches its share; sources of no tokens get
nothing, which the shares reached show; sources without a target are not
used; null and empty texts have no tokens and no uses; copies of a text in
one source count as one text, used under the smallest document id; a text in
several sources is used at most the smallest of their max_repeats in all.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import deque
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscale.runtime import attach_group, cut_lineage, salt

#: Where the vocabulary files of public tokenizers are, and which one counts.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the public byte-level vocabulary splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of a pattern that one task orders.
ORDERED_ROWS = 50_000
SEED = 20_240_611


@cache
def _encoding(folder: str, vocabulary: str):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, text_hash, n_tokens) of (doc_id, source, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            texts = [text or "" for text in batch.column(2).to_pylist()]
            hashes = [hashlib.md5(text.encode(), usedforsecurity=False).digest() for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array([len(encode(text)) for text in texts], pa.int64())], names=["doc_id", "source", "text_hash", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(count, "doc_id long, source string, text_hash binary, n_tokens long")


class Flow:
    """Maximum flow that can be extended (Dinic)."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, start: int, end: int, capacity: int) -> int:
        self.out[start].append(len(self.to))
        self.out[end].append(len(self.to) + 1)
        self.to += [end, start]
        self.room += [capacity, 0]
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            level = [-1] * len(self.out)
            level[source] = 0
            queue = deque([source])
            while queue:
                node = queue.popleft()
                for arc in self.out[node]:
                    if self.room[arc] and level[self.to[arc]] < 0:
                        level[self.to[arc]] = level[node] + 1
                        queue.append(self.to[arc])
            if level[sink] < 0:
                return total
            at = [0] * len(self.out)
            while pushed := self._push(source, sink, level, at):
                total += pushed

    def _push(self, source: int, sink: int, level: list[int], at: list[int]) -> int:
        path: list[int] = []
        node = source
        while node != sink:
            while at[node] < len(self.out[node]):
                arc = self.out[node][at[node]]
                if self.room[arc] and level[self.to[arc]] == level[node] + 1:
                    break
                at[node] += 1
            else:
                if not path:
                    return 0
                back = path.pop()
                node = self.to[back ^ 1]
                at[node] += 1
                continue
            path.append(arc)
            node = self.to[arc]
        amount = min(self.room[arc] for arc in path)
        for arc in path:
            self.room[arc] -= amount
            self.room[arc ^ 1] += amount
        return amount


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> dict[tuple[str, ...], dict[str, int]]:
    """Tokens that each pattern gives to each of its sources, repeating as little as possible, towards quotas of total."""
    names, pools = list(shares), list(patterns)
    flow = Flow(2 + len(names) + len(pools))
    source_node = {name: 2 + i for i, name in enumerate(names)}
    for name in names:
        flow.arc(source_node[name], 1, int(round(shares[name] * total)))
    arcs: dict[tuple[int, str], int] = {}
    inlet = []
    for i, pool in enumerate(pools):
        node = 2 + len(names) + i
        inlet.append(flow.arc(0, node, 0))
        for name in pool:
            arcs[i, name] = flow.arc(node, source_node[name], patterns[pool] * repeats[name])
    most = {pool: min(repeats[name] for name in pool) for pool in pools}
    for use in range(1, max(most.values(), default=0) + 1):
        for i, pool in enumerate(pools):
            if use <= most[pool]:
                flow.room[inlet[i]] += patterns[pool]
        flow.run(0, 1)
    return {pool: {name: flow.room[arcs[i, name] ^ 1] for name in pool} for i, pool in enumerate(pools)}


def largest_total(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which every source with tokens reaches its share."""
    held = {name for pool, tokens in patterns.items() if tokens for name in pool}
    shares = {name: share for name, share in shares.items() if name in held and share > 0}
    if not shares:
        return 0
    patterns = {kept: sum(tokens for pool, tokens in patterns.items() if tuple(n for n in pool if n in shares) == kept) for kept in {tuple(n for n in pool if n in shares) for pool in patterns} - {()}}
    low, high = 0, int(sum(tokens * max(repeats[name] for name in pool) for pool, tokens in patterns.items()) / sum(shares.values())) + 1
    while high - low > max(1, low // 1_000_000):
        middle = (low + high) // 2
        given = route(patterns, shares, repeats, middle)
        reached = sum(sum(parts.values()) for parts in given.values())
        if reached >= sum(int(round(share * middle)) for share in shares.values()):
            low = middle
        else:
            high = middle
    return low


def uses(documents: DataFrame, targets: DataFrame, total: int | str | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of every document of a listed source, and of the others with no tokens counted.

    total is a number of tokens, "pool" for the tokens of all listed texts once, or None for the largest that reaches all shares.
    """
    wanted = {row.source: (float(row.target_share), int(row.max_repeats or 0)) for row in targets.where("source is not null and target_share > 0").select("source", "target_share", "max_repeats").collect()}
    shares, repeats = {name: share for name, (share, _) in wanted.items()}, {name: times for name, (_, times) in wanted.items()}
    listed = documents.where(F.col("source").isin(*wanted)) if wanted else documents.where(F.lit(False))
    counted = cut_lineage(token_counts(listed, folder, vocabulary))
    held = counted.where("n_tokens > 0").groupBy("text_hash", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = held.groupBy("text_hash").agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("places"))
    texts = cut_lineage(texts.withColumn("pattern", F.array_join("places.source", "\x1f")))
    sums = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    rows = sums.collect()
    patterns = {tuple(row.pattern.split("\x1f")): row.tokens for row in rows}
    texts_of = {tuple(row.pattern.split("\x1f")): row.n for row in rows}
    if total == "pool":
        total = sum(patterns.values())
    elif total is None:
        total = largest_total(patterns, shares, repeats)
    given = route(patterns, shares, repeats, int(total))
    # the stretches of a pattern's flow, laid end to end: source, from, to
    stretches = []
    for pool, parts in given.items():
        at = 0
        for name in sorted(parts):
            if parts[name]:
                stretches.append(("\x1f".join(pool), patterns[pool], name, at, at + parts[name], texts_of[pool]))
                at += parts[name]
    spark = documents.sparkSession
    plan = spark.createDataFrame(stretches, "pattern string, size long, source string, low long, high long, n long")
    plan = plan.groupBy("pattern", "size", "n").agg(F.array_sort(F.collect_list(F.struct("low", "high", "source"))).alias("stretches"))
    # the place of a text in its pattern's order: buckets by seeded hash, then within a bucket
    buckets = max(16, min(65_536, sum(row.n for row in rows) // ORDERED_ROWS))
    order = F.xxhash64(F.lit(seed), "text_hash")
    spread = texts.withColumns({"order": order, "bucket": salt("text_hash", buckets, seed + 1)})
    sizes = spread.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("pattern", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("pattern", "bucket").orderBy("order", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    # a pattern may hold a third of the texts, so frequent ones are joined apart
    placed = attach_group(spread.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(starts, ["pattern", "bucket"]), plan, ["pattern"], "n")
    position = (F.col("start") + F.col("inner")).alias("at")
    placed = placed.select("places", "size", "stretches", position)
    each = placed.select("at", "size", "places", F.explode("stretches").alias("s"))
    # uses of a text in a stretch: the k for which at + k * size lies in it
    first = F.greatest(F.lit(0), F.ceil((F.col("s.low") - F.col("at")) / F.col("size")))
    last = F.ceil((F.col("s.high") - F.col("at")) / F.col("size"))
    chosen = each.select(F.element_at(F.filter("places", lambda p: p["source"] == F.col("s.source")), 1)["doc_id"].alias("doc_id"), (last - first).cast("long").alias("uses")).where("uses > 0")
    counts = counted.select("doc_id", "source", "n_tokens").join(chosen, "doc_id", "left").select("doc_id", "source", "n_tokens", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"))
    others = documents.where(F.col("source").isNull() | ~F.col("source").isin(*wanted)) if wanted else documents
    return counts.unionByName(others.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.lit(None).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("uses")))


def shares_reached(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, most_uses) of each target."""
    by = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    joined = targets.join(by, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    # as many rows as there are targets, so a window over all of them is small
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return joined.select("source", "target_share", "max_repeats", "tokens", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("share"), "most_uses")

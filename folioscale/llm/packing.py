"""Items of varying size into containers of a few permitted capacities.

Best fit over size classes instead of single items: the items of a pool
(here a plan) are counted by size, sizes being at most the largest capacity,
and one small task per pool packs these counts, largest size first, into the
open bins with the least room that still holds them, whole stacks of equal
bins at a time. When no bin fits, bins of the capacity with the least cost
per packed unit are opened, and at the end each bin is cut down to the
smallest permitted capacity that holds its contents. This is tried for a few
costs of opening, and with each opened bin filled as fully as can be found;
the way of least cost is taken, a bin costing its capacity and OPENING_COST
times the limit. Items are then numbered within their pool and size, without
one task per pool, and looked up in the pool's layout. The work per pool
depends on the number of sizes, not items, and is done alike at any size.

Defined results: an item larger than the largest capacity, and no other, is
split into full pieces and a rest; items without a positive count have
nothing to pack and are reported with the state "empty"; items without a
positive limit, "no limit"; null tags count as none; repeated rows are one
item: of several rows of an id the largest (by plan, count, limit, tags)
counts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscale.runtime import attach_group, cut_lineage, map_groups, numbered

#: Permitted capacities as fractions of the limit, the cost of a bin besides its capacity, and the costs tried when bins are opened, in units of the limit.
FRACTIONS = (1.0, 0.75, 0.5, 0.25)
OPENING_COST = 4.0
OPENINGS = (0.25, 1.0, 4.0)
#: Groups of equal items looked at, largest first, to fill an opened bin.
LOOK = 256
#: Items that one task numbers.
NUMBERED_ROWS = 50_000


def capacities(limit: int, fractions: tuple[float, ...] = FRACTIONS) -> list[int]:
    """The permitted capacities of a limit, smallest first."""
    return sorted({max(1, int(limit * fraction)) for fraction in fractions} | {limit})


def pack_counts(sizes: dict[int, int], permitted: list[int], opening: float) -> list[tuple[int, int, dict[int, int]]]:
    """Stacks (capacity, bins, items of each size in a bin) that hold sizes[s] items of every size s.

    opening is the cost of a bin besides its capacity.
    """
    largest = max(permitted)
    # open stacks by room: room -> list of [capacity, bins, contents]; rooms is its sorted list of keys
    stacks: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(capacity: int, bins: int, contents: dict[int, int]) -> None:
        room = capacity - sum(size * n for size, n in contents.items())
        if room not in stacks:
            stacks[room] = []
            insort(rooms, room)
        stacks[room].append([capacity, bins, contents])

    def take(room: int) -> list:
        stack = stacks[room].pop()
        if not stacks[room]:
            del stacks[room]
            rooms.pop(bisect_left(rooms, room))
        return stack

    def bulk(capacity: int, size: int, left: int) -> float:
        """Cost per packed unit of bins of this capacity filled from what is left, smaller sizes filling their rest."""
        each = min(capacity // size, left)
        if not each:
            return float("inf")
        rest = sum(s * n for s, n in remaining.items() if s < size)
        packed = min(capacity, each * size + rest)
        return (capacity + opening) / packed

    remaining = dict(sizes)
    for size in sorted(sizes, reverse=True):
        left = remaining.pop(size)
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):  # the tightest open bins
                room = rooms[at]
                capacity, bins, contents = take(room)
                each = min(room // size, max(1, left // bins))
                filled = min(bins, left // each)
                put(capacity, filled, {**contents, size: contents.get(size, 0) + each})
                if bins > filled:
                    put(capacity, bins - filled, contents)
                left -= filled * each
            else:
                capacity = min(permitted, key=lambda c: (bulk(c, size, left), -c)) if size <= largest else largest
                each = min(capacity // size, left)
                bins = left // each
                put(capacity, bins, {size: each})
                left -= bins * each
    out = []
    for same in stacks.values():
        for capacity, bins, contents in same:
            filled = sum(size * n for size, n in contents.items())
            out.append((next(c for c in permitted if c >= filled), bins, contents))
    return out


def fullest(room: int, available: list[tuple[int, int]]) -> dict[int, int]:
    """Items (size, n), largest first, that fill a room best: sums that can be reached are the bits of a number."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for size, n in available:
        times = 1
        while n and size * times <= room and len(steps) < LOOK and not reach >> room & 1:
            times = min(times, n)
            steps.append((size, times, reach))
            reach |= reach << size * times & mask
            n -= times
            times *= 2
    at, contents = reach.bit_length() - 1, {}
    for size, times, before in reversed(steps):
        if not before >> at & 1:
            contents[size] = contents.get(size, 0) + times
            at -= size * times
    return contents


def fullest_counts(sizes: dict[int, int], permitted: list[int]) -> list[tuple[int, int, dict[int, int]]]:
    """As pack_counts, each bin opened for the largest item left and filled with the sizes that best fit its whole room."""
    limit, left, out = max(permitted), dict(sorted(sizes.items(), reverse=True)), []
    while left:
        largest = next(iter(left))
        rest = ((size, n - (size == largest)) for size, n in left.items() if size <= limit - largest)
        contents = fullest(limit - largest, list(islice(rest, LOOK)))
        contents[largest] = contents.get(largest, 0) + 1
        bins = min(left[size] // n for size, n in contents.items())
        for size, n in contents.items():
            left[size] -= n * bins
            if not left[size]:
                del left[size]
        filled = sum(size * n for size, n in contents.items())
        out.append((next(c for c in permitted if c >= filled), bins, contents))
    return out


def cost(stacks: list[tuple[int, int, dict[int, int]]], limit: int) -> float:
    return sum(bins * (capacity + OPENING_COST * limit) for capacity, bins, _ in stacks)


def pack_best(sizes: dict[int, int], limit: int) -> list[tuple[int, int, dict[int, int]]]:
    """The stacks of least cost, of the ways to open and fill bins."""
    permitted = capacities(limit)
    tries = [pack_counts(sizes, permitted, opening * limit) for opening in OPENINGS]
    return min([*tries, fullest_counts(sizes, permitted)], key=lambda stacks: cost(stacks, limit))


_LAYOUT = "pool long, bins long, size int, n long, slots array<struct<first:long,bin:long,each:int,capacity:int>>"


def _lay_out(pool: pd.DataFrame) -> pd.DataFrame:
    """For each size of a pool: from which item number on, into which bins, how many a bin."""
    limit = int(pool["capacity"].iloc[0])
    counts = dict(zip(pool["size"].astype(int), pool["n"].astype(int)))
    slots: dict[int, list] = {size: [] for size in counts}
    given = dict.fromkeys(counts, 0)
    bin_no = 0
    for capacity, bins, contents in sorted(pack_best(counts, limit), key=lambda x: (-x[0], sorted(x[2].items(), reverse=True), x[1])):
        for size, each in contents.items():
            slots[size].append({"first": given[size], "bin": bin_no, "each": each, "capacity": capacity})
            given[size] += bins * each
        bin_no += bins
    return pd.DataFrame([{"pool": pool["pool"].iloc[0], "bins": bin_no, "size": size, "n": counts[size], "slots": slots[size]} for size in counts])


def pieces(items: DataFrame, item: str, pool: str, count: str, limit: str) -> DataFrame:
    """(item, pool, capacity, piece_no, size): each item whole, or in full pieces and a rest where it exceeds the limit."""
    sized = items.where((F.col(count) > 0) & (F.col(limit) > 0) & F.col(pool).isNotNull())
    full = F.floor(F.col(count) / F.col(limit)).cast("long")
    rest = (F.col(count) % F.col(limit)).cast("int")
    number = full + F.when(rest > 0, 1).otherwise(0)
    return sized.select(
        F.col(item).cast("long").alias("item"), F.col(pool).cast("long").alias("pool"), F.col(limit).cast("int").alias("capacity"),
        F.explode(F.sequence(F.lit(1).cast("long"), number)).alias("piece_no"), full.alias("_full"), rest.alias("_rest"),
    ).select("item", "pool", "capacity", "piece_no", F.when(F.col("piece_no") <= F.col("_full"), F.col("capacity")).otherwise(F.col("_rest")).alias("size"))


def pack(items: DataFrame, item: str, pool: str, count: str, limit: str) -> DataFrame:
    """(pool, bin, capacity, item, piece_no, size): every piece of every item in a bin.

    The limit is that of the pool; where a pool's rows name several, each
    limit is packed apart (bins are numbered within pool and limit).
    """
    parts = pieces(items, item, pool, count, limit).withColumnRenamed("pool", "plan")
    # pool and limit together name what is packed together
    parts = parts.withColumn("pool", F.xxhash64("plan", "capacity"))
    # a full piece fills a bin of its own: no packing, and no skew from huge items
    whole = parts.where(F.col("size") == F.col("capacity"))
    loose = parts.where(F.col("size") < F.col("capacity"))
    counts = loose.groupBy("pool", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))
    layout = cut_lineage(map_groups(counts, "pool", _lay_out, _LAYOUT))
    ordered = loose.withColumn("_order", F.xxhash64("item", "piece_no"))
    placed = attach_group(numbered(ordered, ["pool", "size"], "_order", "number", _buckets(layout)), layout.drop("bins"), ["pool", "size"], "n")
    slot = F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("number")), -1)
    placed = placed.withColumn("slot", slot).select("plan", F.col("capacity").alias("limit"), (F.col("slot.bin") + F.floor((F.col("number") - F.col("slot.first")) / F.col("slot.each"))).cast("long").alias("bin"), F.col("slot.capacity").alias("capacity"), "item", "piece_no", "size")
    # bins of full pieces have the numbers after those of the layout, by hash of the piece
    after = cut_lineage(whole.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).join(layout.select("pool", "bins").distinct(), "pool", "left").withColumn("bins", F.coalesce("bins", F.lit(0))))
    full = numbered(whole.withColumn("_order", F.xxhash64("item", "piece_no")), ["pool"], "_order", "number", _buckets(after))
    full = attach_group(full, after, ["pool"], "n")
    full = full.select("plan", F.col("capacity").alias("limit"), (F.col("bins") + F.col("number")).alias("bin"), "capacity", "item", "piece_no", "size")
    return placed.unionByName(full)


def _buckets(groups: DataFrame) -> int:
    """Buckets to number the rows of groups (n) in, so that a hot group is spread over tasks of about NUMBERED_ROWS."""
    return max(64, min(65_536, (groups.agg(F.sum("n")).first()[0] or 0) // NUMBERED_ROWS))


def batches(items: DataFrame) -> DataFrame:
    """The batches of dispatch_items: one row per batch with its items, tags, filled size and capacity."""
    whole = F.max(F.struct("plan_id", "item_count", "batch_limit", F.coalesce("tags", F.array().cast(T.ArrayType(T.StringType()))).alias("tags")))
    items = items.groupBy("item_id").agg(whole.alias("r")).select("item_id", "r.*")
    packed = pack(items, "item_id", "plan_id", "item_count", "batch_limit")
    # an item may have any number of pieces
    pieces_of = F.ceil(F.col("item_count") / F.col("batch_limit")).cast("long").alias("n")
    tagged = attach_group(packed, items.where("item_count > 0 and batch_limit > 0").select(F.col("item_id").cast("long").alias("item"), "tags", pieces_of), ["item"], "n")
    grouped = tagged.groupBy(F.col("plan").alias("plan_id"), "limit", "bin").agg(
        F.max("capacity").alias("capacity"),
        F.sum("size").cast("long").alias("filled"),
        F.count(F.lit(1)).cast("long").alias("n_items"),
        F.array_sort(F.collect_list(F.struct(F.col("item").alias("item_id"), "piece_no", F.col("size").alias("item_count")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast(T.ArrayType(T.StringType()))))))).alias("tags"),
    )
    return grouped.select("plan_id", F.col("bin").alias("batch_no"), F.col("limit").alias("batch_limit"), "capacity", "filled", "n_items", "items", "tags")


def unpacked(items: DataFrame) -> DataFrame:
    """Items with nothing to pack or no limit, with the reason."""
    reason = F.when(F.col("plan_id").isNull(), "no plan").when(F.coalesce(F.col("batch_limit"), F.lit(0)) <= 0, "no limit").when(F.coalesce(F.col("item_count"), F.lit(0)) <= 0, "empty")
    return items.withColumn("state", reason).where(F.col("state").isNotNull()).select("plan_id", "item_id", "state")

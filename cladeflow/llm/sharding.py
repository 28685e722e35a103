"""Minimax contiguous sharding: the smallest feasible shard capacity over ordered atomic groups.

Groups of equal texts, ordered by a hash, are atoms. Their sizes are summed over hash ranges; a binary search
with a greedy check finds the smallest capacity, and only ranges in which a cut can fall are split further,
until the cuts are exact. Only sums of ranges reach the driver, never groups or documents.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cladeflow.llm.shared_files import Tables, columns

#: Bits of the hash by which ranges are told apart, coarse to fine.
LEVELS = (12, 20, 28, 36, 44, 52, 64)
#: Rows of a shard that are numbered together.
SLOTS = 20_000


@dataclass
class Range:
    start: int  # its first hash
    size: int
    groups: int
    level: int


def greedy(sizes: list[int], shards: int, capacity: int) -> list[int] | None:
    """Starts of the shards when each takes atoms while they fit; None if more than ``shards`` are needed."""
    starts, held = [0], 0
    for i, size in enumerate(sizes):
        if held + size > capacity:
            if size > capacity or len(starts) == shards:
                return None
            starts.append(i)
            held = 0
        held += size
    return starts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search over capacities."""
    low, high = max([-(-sum(sizes) // shards), *sizes], default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if greedy(sizes, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def level_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Starts of the shards: each closes as soon as it has its even share of what is left, if the others can
    hold the rest within ``capacity``, and otherwise takes all that fits."""
    before = [0]
    for s in sizes:
        before.append(before[-1] + s)
    starts = [0]
    for shard in range(shards - 1):
        at = starts[-1]
        share = (before[-1] - before[at]) / (shards - shard)
        most = bisect_right(before, before[at] + capacity) - 1
        near = bisect_right(before, before[at] + share) - 1
        choices = sorted({min(max(k, at), most) for k in (near, near + 1)}, key=lambda k: abs(before[k] - before[at] - share))
        fits = [k for k in choices if greedy(sizes[k:], shards - shard - 1, capacity) is not None]
        starts.append(fits[0] if fits else most)
    return starts


def _open_ranges(ranges: list[Range], shards: int, capacity: int, least: int) -> list[Range]:
    """Ranges of several groups in which a greedy cut of some capacity from ``least`` to ``capacity`` can fall."""
    before = [0]
    for r in ranges:
        before.append(before[-1] + r.size)
    found, low, high = set(), 0, 0
    for _ in range(shards - 1):
        low = before[max(0, bisect_right(before, low + least) - 1)]
        high = min(high + capacity, before[-1])
        first, last = bisect_right(before, low) - 1, bisect_right(before, high) - 1
        found.update(range(max(0, first), min(last + 1, len(ranges))))
    return [ranges[i] for i in sorted(found) if ranges[i].groups > 1 and ranges[i].level < len(LEVELS) - 1]


def _ranges(groups: DataFrame, level: int, inside: list[Range] | None) -> list[Range]:
    """Sums over hash ranges, of all groups or of those in given ranges of the level before."""
    if inside is not None:
        groups = groups.filter(_prefix(LEVELS[level - 1]).isin([r.start >> (64 - LEVELS[level - 1]) for r in inside]))
    rows = groups.groupBy(_prefix(LEVELS[level]).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return [Range(r["prefix"] << (64 - LEVELS[level]), int(r["bytes"]), r["n"], level) for r in rows.collect()]


def _prefix(bits: int) -> Column:
    return F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")


def find_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First hash of shards 1, 2, ... . ``groups`` has ``key`` (a 64-bit hash) and ``bytes``."""
    top = groups.agg(F.max("bytes").alias("m"), F.sum("bytes").alias("s")).first()
    if top["s"] is None:
        return []
    least = max(int(top["m"]), -(-int(top["s"]) // shards))
    ranges = sorted(_ranges(groups, 0, None), key=lambda r: r.start)
    while True:
        sizes = [r.size for r in ranges]
        capacity = smallest_capacity(sizes, shards)
        open_ = [] if capacity == least else _open_ranges(ranges, shards, capacity, least)
        if not open_:
            break
        level = min(r.level for r in open_)
        split = [r for r in open_ if r.level == level]
        gone = {r.start for r in split}
        ranges = [r for r in ranges if r.level != level or r.start not in gone] + _ranges(groups, level + 1, split)
        ranges.sort(key=lambda r: r.start)
    starts = level_cuts(sizes, shards, capacity)
    return [ranges[i].start if i < len(ranges) else None for i in starts[1:]]


def shard_by_bytes(docs: DataFrame, carry: list[str], shards: int = 8) -> DataFrame:
    """``carry`` columns of each document as the struct ``row``, with ``size`` (UTF-8 bytes of the text plus 1),
    ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Documents with equal texts share a shard; the largest shard is as small as any contiguous cut of the groups,
    ordered by hash, allows. A null text counts as empty, and goes where the empty text goes. Repeated rows
    all stay. An empty table gives no rows; with fewer groups than shards some shards are empty. Only what
    ``carry`` names is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.struct(*columns(carry)).alias("row"),
        F.xxhash64(text).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    tables = Tables(docs.sparkSession)
    groups = tables.store(sized.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.sum("n").alias("n")).first()["n"] or 0
    shard = F.lit(0)
    for cut in find_cuts(groups, shards):
        if cut is not None:
            shard = shard + (F.col("key") >= F.lit(cut)).cast("int")
    tables.drop(groups)
    salts = 1 + total // (shards * SLOTS)
    placed = sized.withColumn("shard", shard).withColumn("salt", F.pmod(F.xxhash64("row", "text_crc32"), F.lit(salts)))
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    by_shard = W.Window.partitionBy("shard").orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "salt", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before"))
    # by the whole row: what is equal here may change places, so that a task that runs again gives out the same slots
    inside = W.Window.partitionBy("shard", "salt").orderBy("key", "text_crc32", "size", "row")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1)
    slot = (F.col("before") + F.col("at")).cast("long").alias("slot")
    return numbered.join(offsets, ["shard", "salt"]).select("row", "size", "text_crc32", "shard", slot)

"""Which members of hash buckets may be links, and comparing them in blocks of bounded size.

``candidate_groups`` sorts members by bucket and ties those of a bucket whose short sketches agree well enough; what is
tied, through any buckets, is a group. ``meetings`` deals a group's members into blocks, every two of which meet in a
task; ``link`` compares the rows of each meeting with numpy. Every pair of a group meets once, and no pair becomes
a row. These rules are the same for groups of all sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.components import connected_components
from cladeflow.llm.shared_files import Tables

BLOCK = 256
#: Pairs that are compared at once.
PAIRS = 1 << 17
#: Members of a bucket that are held at a time.
CHUNK = 1 << 16
#: Rows that are compared with all others before the rest, where only ties count.
LEADERS = 4
#: Buckets of more members are searched from seeds and not pair by pair.
FEW = 8

#: Given what was made of the columns of payload and pairs of positions in them, tells which pairs are links.
Compare = Callable[[Any, np.ndarray, np.ndarray], np.ndarray]


@lru_cache(maxsize=BLOCK)
def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _agree(sketch: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """How many bits are the same."""
    return 64 * sketch.shape[1] - np.bitwise_count(sketch[a] ^ sketch[b]).sum(-1).astype(np.int64)


def _ties(sketch: np.ndarray, starts: np.ndarray, ends: np.ndarray, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that connect the members of each bucket which agree in ``fewest`` bits or more."""
    sizes, left, right = ends - starts, [], []
    for n in range(2, FEW + 1):
        first = starts[sizes == n]
        i, j = _all_pairs(n)
        for at in range(0, len(first), max(1, PAIRS // len(i))):
            some = first[at : at + max(1, PAIRS // len(i)), None]
            a, b = (some + i).ravel(), (some + j).ravel()
            yes = _agree(sketch, a, b) >= fewest
            left.append(a[yes])
            right.append(b[yes])
    for start, end in zip(starts[sizes > FEW].tolist(), ends[sizes > FEW].tolist()):
        open_ = np.arange(start, end)
        while len(open_):
            queue, open_ = [int(open_[0])], open_[1:]
            while queue and len(open_):
                seed = queue.pop()
                yes = _agree(sketch, seed, open_) >= fewest
                hit, open_ = open_[yes], open_[~yes]
                left.append(np.full(len(hit), seed))
                right.append(hit)
                queue += hit.tolist()
    empty = [np.empty(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def _tied(fewest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets at either end of a task's range may go on in another task: their members are tied without a look,
        and one is named with the bucket. So are the members of a bucket too large to be held."""
        held: pa.Table | None = None
        first, whole = True, True  # in the first bucket; nothing of the held bucket was let go
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            bucket = table.column("bucket").to_numpy()
            ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
            if len(ends) > 1:
                if first or not whole:
                    yield _starred(table.slice(0, ends[0]))
                    first, whole, begin = False, True, 1
                else:
                    begin = 0
                starts = np.append(0, ends[:-1])[begin:-1]
                if len(starts):
                    yield _compared(table.slice(0, ends[-2]), starts, ends[begin:-1], fewest)
                table = table.slice(ends[-2])
            if len(table) > CHUNK:
                yield _starred(table)
                table, whole = table.slice(0, 1), False
            held = table
        if held is not None:
            yield _starred(held)

    return run


def _edges(a: pa.Array, b: pa.Array, bucket: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a, b, bucket], names=["a", "b", "bucket"])


def _starred(table: pa.Table) -> pa.RecordBatch:
    keys = table.column("key").combine_chunks()
    bucket = pa.array([table.column("bucket")[0].as_py()] + [None] * (len(keys) - 1), pa.int64())
    return _edges(keys, keys.take(pa.array(np.zeros(len(keys), np.int64))), bucket)


def _compared(table: pa.Table, starts: np.ndarray, ends: np.ndarray, fewest: int) -> pa.RecordBatch:
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(table), -1)
    a, b = _ties(sketch, starts, ends, fewest)
    keys = table.column("key").combine_chunks()
    return _edges(keys.take(pa.array(a)), keys.take(pa.array(b)), pa.nulls(len(a), pa.int64()))


def candidate_ties(members: DataFrame, fewest: int, tables: Tables) -> DataFrame:
    """Links ``a``, ``b`` that hold together whatever shares a ``bucket`` and agrees in ``fewest`` bits of ``sketch`` or
    more, as one of ``tables``. ``members`` has ``key`` (binary) too. A bucket of any size is dealt over tasks by ranges."""
    rows = members.select("bucket", "key", "sketch").repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    found = tables.store(rows.mapInArrow(_tied(fewest), "a binary, b binary, bucket long"))
    # at most two rows a task
    open_ = found.filter("bucket is not null").select("bucket", "a")
    least = open_.groupBy("bucket").agg(F.min("a").alias("b"))
    out = tables.store(found.filter("a != b").select("a", "b").union(open_.join(least, "bucket").filter("a != b").select("a", "b")).distinct())
    tables.drop(found)
    return out


def candidate_groups(ties: DataFrame, tables: Tables) -> DataFrame:
    """``group``, ``key`` and ``n`` (members of the group), for :func:`meetings`."""
    roots = connected_components(ties, tables)
    members = roots.select(F.col("root").alias("group"), F.col("id").alias("key"))
    members = members.union(roots.select(F.col("root").alias("group"), F.col("root").alias("key")).distinct())
    sizes = roots.groupBy(F.col("root").alias("group")).agg((F.count("*") + 1).alias("n"))
    return members.join(sizes, "group")


def meetings(members: DataFrame) -> DataFrame:
    """``members`` has ``group``, ``key`` and ``n``. Returns rows ``group``, ``low``, ``high``, ``side`` and ``key``: a place of a
    member in the meeting of two of its group's blocks, or of a block with itself. Where there is a column ``probe``, members
    with it meet only those without it; ``n`` counts the latter and ``probes`` the former."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine, others = F.pmod(F.xxhash64("key", "group"), blocks), blocks
    if "probe" in members.columns:
        more = F.ceil(F.col("probes") / BLOCK).cast("int")
        mine = F.when(F.col("probe"), blocks + F.pmod(F.xxhash64("key", "group"), more)).otherwise(mine)
        others = F.when(F.col("probe"), blocks).otherwise(blocks + more)
    rows = members.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    low, high = F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")
    return rows.select(F.xxhash64("group").alias("group"), low, high, (F.col("mine") > F.col("other")).cast("int").alias("side"), "key")


def link(members: DataFrame, payload: DataFrame, prepare: Callable[[dict[str, list]], Any], compare: Compare, key_type: str, count: bool = True) -> DataFrame:
    """Rows ``key``, ``linked`` and ``root``: a share of the ``copies`` that a key links to, to be added up, and a
    smaller or equal key that it is tied to. ``payload`` has ``key``, ``copies`` and columns
    that ``prepare`` makes ready for ``compare``, once for many meetings. Without
    ``count``, what is tied already is not compared, and ``linked`` is 1."""
    columns = [c for c in payload.columns if c not in ("key", "copies")]
    rows = meetings(members).join(payload, "key").select("group", "low", "high", "side", "key", "copies", *columns)
    rows = rows.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            ends = _ends(table)
            if len(ends) > 1:
                yield from _compare_all(table.slice(0, ends[-2]), ends[:-1], columns, prepare, compare, count)
                table = table.slice(ends[-2])
            held = table
        if held is not None and len(held):
            yield from _compare_all(held, _ends(held), columns, prepare, compare, count)

    return rows.mapInArrow(run, f"key {key_type}, linked long, root {key_type}")


def _ends(table: pa.Table) -> list[int]:
    """Where each meeting's rows end."""
    new = np.zeros(len(table), bool)
    for x in (table.column(c).to_numpy() for c in ("group", "low", "high")):
        new[1:] |= x[1:] != x[:-1]
    return [*np.flatnonzero(new).tolist(), len(table)]


def _compare_all(table: pa.Table, ends: list[int], columns: list[str], prepare: Callable[[dict[str, list]], Any], compare: Compare, count: bool) -> Iterator[pa.RecordBatch]:
    side = table.column("side").to_numpy()
    two_blocks = table.column("low").to_numpy() < table.column("high").to_numpy()
    copies, keys = table.column("copies").to_numpy(), table.column("key").to_pylist()
    data = prepare({c: table.column(c).to_pylist() for c in columns})
    linked, root = np.zeros(len(table), np.int64), list(range(len(table)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that are not tied yet."""
        tops = np.array([top(i) for i in range(int(min(a.min(), b.min())), int(max(a.max(), b.max())) + 1)])
        low = min(a.min(), b.min())
        rest = tops[a - low] != tops[b - low]
        return a[rest], b[rest]

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        if not count and len(a):
            a, b = apart(a, b)
        yes = compare(data, a, b)
        a, b = a[yes], b[yes]
        if count:
            np.add.at(linked, a, copies[b])
            np.add.at(linked, b, copies[a])
        else:
            linked[a] = linked[b] = 1
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = top(i), top(j)
            if i != j:
                if keys[j] < keys[i]:
                    i, j = j, i
                root[j] = i

    def leaders(some: np.ndarray, others: np.ndarray) -> None:
        """A few rows against all others first: where most are copies of one, few pairs are left to compare."""
        seen: set[int] = set()
        for i in some.tolist():
            if len(seen) == LEADERS:
                break
            if top(i) not in seen:
                settle(np.full(len(others), i), others)
                seen.add(top(i))

    left, right, waiting = [], [], 0
    for start, end in zip([0, *ends], ends):
        n = end - start
        if two_blocks[start]:
            high = side[start:end].astype(bool)
            one, two = start + np.flatnonzero(~high), start + np.flatnonzero(high)
            if not count:
                leaders(one, two)
                leaders(two, one)
            step = max(1, PAIRS // max(1, len(two)))
            for at in range(0, len(one), step):
                some = one[at : at + step]
                settle(np.repeat(some, len(two)), np.tile(two, len(some)))
        elif n > 1:
            if n > 2 * FEW and not count:
                leaders(np.arange(start, end), np.arange(start, end))
            i, j = _all_pairs(n)
            left.append(start + i)
            right.append(start + j)
            waiting += len(i)
            if waiting >= PAIRS:
                settle(np.concatenate(left), np.concatenate(right))
                left, right, waiting = [], [], 0
    if left:
        settle(np.concatenate(left), np.concatenate(right))
    rows = np.flatnonzero(linked > 0)
    if len(rows):
        kind = table.schema.field("key").type
        tied = [keys[top(i)] for i in rows.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in rows], kind), pa.array(linked[rows]), pa.array(tied, kind)], names=["key", "linked", "root"])

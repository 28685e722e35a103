"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source, document after document in a pseudorandom order, are packed into blocks. A source takes part with as
many slots as its target has blocks. How many of them an output shard gets is a multinomial draw, source by source: the law
of independent draws of shards once the sources' totals are given, so that the totals hold exactly. A slot is mapped to a block by a
pseudorandom permutation of the source's blocks, a new one for each time that they have all been taken, and joined with it
by its index. All that is drawn follows from ``seed`` and the rows, so that reruns agree.

What grows with the data is tables: documents, blocks and slots. A source is one row of the table of sources, whose ranks and
targets need it in order; its words are numbered in ``BUCKETS`` buckets, so that a source with a third of all rows is no task's
alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cladeflow.llm.shared_files import Tables
from cladeflow.llm.words import mix64

WEIGHTS = (5, 2, 1)
#: Words of a block; slots of an output shard on average; times that a source's words may be taken.
BLOCK, SHARD, MOST = 512, 4096, 3
#: Parts of a source in which its words are numbered; shards that one draw tells apart.
BUCKETS, FAN = 4096, 4096
ROUNDS = 6


def word_count(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permuted(i: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n - 1 takes numbers, or whence they came: a Feistel network over the next power
    of four, walked until the result is below ``n``."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = i.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & mask)
        out[walk] = left << half | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def _key(*parts: int) -> int:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = mix64(out + np.uint64(p & (2**64 - 1)) + np.uint64(0x9E3779B97F4A7C15))
    return int(out[0])


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` and ``target`` to a table of sources (missing, source, source_size): weights repeat in order of the names, null
    last, and share out all words; no target is above three times its source's size, and what that leaves goes to the others by
    weight until none is above."""
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS)).cast("int") + 1)
    ranked = sources.withColumn("rank", F.row_number().over(W.Window.orderBy("missing", "source")).cast("long") - 1).withColumn("weight", weight)
    # sources that stop first come first: with a level for those after them, the right level is the highest
    first = W.Window.orderBy(MOST * F.col("source_size") / F.col("weight"), "rank")
    before = F.coalesce(F.sum(MOST * F.col("source_size")).over(first.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(first.rowsBetween(0, W.Window.unboundedFollowing))
    every = W.Window.partitionBy()
    levels = ranked.withColumn("level", (F.sum("source_size").over(every) - before) / after)
    level = F.max("level").over(every)
    return levels.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), level * F.col("weight"))).drop("level", "weight")


def _plan(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds ``blocks``, the ``slots`` that hold the target, and ``last``, the words that the last of them takes."""

    def run(batches):
        for batch in batches:
            blocks, slots, last = [], [], []
            for rank, size, goal in zip(*(batch.column(c).to_pylist() for c in ("rank", "source_size", "goal"))):
                k = -(-size // block)
                blocks.append(k)
                whole, rest = divmod(goal, size) if size else (0, 0)
                n, cut = 0, block
                if rest:
                    # in the last round a short block comes after ``at`` whole ones
                    at = int(permuted(np.array([k - 1]), k, _key(seed, rank, whole), inverse=True)[0])
                    short = size - (k - 1) * block
                    done, n = (0, 0) if rest <= at * block else (at * block, at) if rest <= at * block + short else (at * block + short, at + 1)
                    more = -(-(rest - done) // block)
                    n, cut = n + more, rest - done - (more - 1) * block
                slots.append(whole * k + n)
                last.append(cut)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (blocks, slots, last))], names=[*batch.schema.names, "blocks", "slots", "last"])

    goals = sources.withColumn("goal", F.round("target").cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in goals.schema) + ", blocks long, slots long, last long"
    return goals.mapInArrow(run, schema)


def _drawn(rows: DataFrame, seed: int, fan: int) -> DataFrame:
    """Deals ``count`` slots from ``start`` of each row (rank, low, high, start, count) to the parts of its shards low .. high - 1, of ``fan`` shards each."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("rank", "low", "high", "start", "count")}
            for rank, low, high, start, count in zip(*(batch.column(c).to_pylist() for c in out)):
                edges = np.append(np.arange(low, high, fan), high)
                widths = np.diff(edges)
                counts = np.random.default_rng([seed, rank, low, fan]).multinomial(count, widths / widths.sum())
                starts = start + np.cumsum(counts) - counts
                some = np.flatnonzero(counts)
                for name, value in zip(out, (np.full(len(some), rank), edges[:-1][some], edges[1:][some], starts[some], counts[some])):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *v]), pa.int64()) for v in out.values()], names=list(out))

    return rows.mapInArrow(run, "rank long, low long, high long, start long, count long")


def mixed_slots(plan: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """The mix: a row per slot with its ``shard`` and place ``slot`` there, the ``rank`` of its source, the ``block`` it holds, and the
    first ``words`` of it that it takes."""
    every = F.greatest(F.ceil(F.sum("slots").over(W.Window.partitionBy()) / shard), F.lit(1))
    whole = plan.select("rank", F.lit(0).cast("long").alias("low"), every.cast("long").alias("high"), F.lit(0).cast("long").alias("start"), F.col("slots").alias("count"))
    parts = _drawn(whole, seed, FAN).repartition("rank", "low")
    counts = _drawn(parts, seed + 1, 1).select("rank", F.col("low").alias("shard"), "start", "count")
    here = W.Window.partitionBy("shard")
    counts = counts.withColumn("begin", F.sum("count").over(here.orderBy("rank").rowsBetween(W.Window.unboundedPreceding, 0)) - F.col("count")).withColumn("size", F.sum("count").over(here))
    counts = counts.join(plan.select("rank", "source_size", "blocks", "slots", "last"), "rank")

    def run(batches):
        names = ("shard", "slot", "rank", "block", "words")
        for batch in batches:
            for r in batch.to_pylist():
                u = np.arange(r["start"], r["start"] + r["count"])
                turn, at = np.divmod(u, r["blocks"])
                index = np.empty_like(u)
                for t in np.unique(turn):
                    index[turn == t] = permuted(at[turn == t], r["blocks"], _key(seed, r["rank"], int(t)))
                words = np.where(index == r["blocks"] - 1, r["source_size"] - (r["blocks"] - 1) * block, block)
                words = np.where(u == r["slots"] - 1, np.minimum(words, r["last"]), words)
                slot = permuted(np.arange(r["begin"], r["begin"] + r["count"]), r["size"], _key(seed, -1, r["shard"]))
                n = np.full(len(u), 1)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (n * r["shard"], slot, n * r["rank"], index, words)], names=names)

    return counts.mapInArrow(run, "shard long, slot long, rank long, block long, words long")


def numbered(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Sources with their targets, and documents with ``rank`` of their source and where they ``start`` in its words."""
    narrow = docs.select("doc_id", F.col("source").isNull().alias("missing"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), word_count("text").alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    narrow = tables.store(narrow.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")))
    buckets = tables.store(narrow.groupBy("missing", "source", "bucket").agg(F.sum("size").alias("held")))
    sources = tables.store(targets(buckets.groupBy("missing", "source").agg(F.sum("held").alias("source_size"))))
    before = W.Window.partitionBy("missing", "source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0)
    begun = buckets.withColumn("begin", F.sum("held").over(before) - F.col("held")).drop("held")
    begun = begun.join(sources.select("missing", "source", "rank", "source_size", "target"), ["missing", "source"])
    inside = W.Window.partitionBy("missing", "source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, 0)
    placed = narrow.withColumn("within", F.sum("size").over(inside) - F.col("size")).join(begun, ["missing", "source", "bucket"])
    return sources, placed.select("doc_id", "size", "rank", "source_size", "target", (F.col("begin") + F.col("within")).alias("start"))


def mix_sources(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text, source): its ``size`` in words, its ``source_size``, its source's ``target``, and the words of it that
    the mix has ``taken``, repeats counted.

    A source's words taken are its target to the nearest word, and none is taken more than three times. Null texts have no words;
    null is a source of its own, after all others; ids may be null or repeat, and repeated rows are rows. An empty table gives an
    empty one. Other columns are not read."""
    tables = Tables(docs.sparkSession)
    sources, placed = numbered(docs, tables)
    plan = tables.store(_plan(sources.select("rank", "source_size", "target"), block, seed))
    placed = tables.store(placed)
    # a block is whole in some slots and, once in a source, in part
    slots = mixed_slots(plan, block, shard, seed)
    slots = slots.groupBy("rank", "block", "words").agg(F.count("*").alias("times"))
    at = lambda edge: F.floor(edge / block).cast("long")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(at(F.col("start")), at(F.col("start") + F.col("size") - 1))))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.select("doc_id", "size", "rank", "source_size", "target", "start", "block", low.alias("low"), high.alias("high"))
    met = pieces.join(slots, ["rank", "block"])
    words = F.coalesce("times", F.lit(0)) * F.greatest(F.least("high", "words") - F.col("low"), F.lit(0))
    # a document with words is told by where it starts
    taken = met.groupBy("rank", "start").agg(F.sum(words).alias("taken"))
    some = placed.filter("size > 0").join(taken, ["rank", "start"], "left")
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = some.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).select("doc_id", "size", "source_size", "target", "taken")
    tables.drop_all(keep=(plan, placed))
    return out.unionByName(none.select("doc_id", "size", "source_size", "target", "taken"))

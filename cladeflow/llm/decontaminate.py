"""Benchmark decontamination: test phrases are searched backward in an FM-index of every training shard."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.llm.fm_index import FMIndex
from cladeflow.llm.shared_files import Tables, columns
from cladeflow.llm.words import words

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


#: Words of a part of an item; longer items come apart, with the words between two parts in both.
PART = 100_000
#: Windows that are searched at once.
AT_ONCE = 1 << 18


class Phrases:
    """Windows of one block of benchmark items: the items' words as numbers, one after another, and where windows start."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        numbers, of = [], []
        for item, text in items:
            tokens = words(text)
            if tokens:
                numbers.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens), np.int32, len(tokens)))
                of.append(names.setdefault(item, len(names)))
        self.items = list(names)
        sizes = np.array([len(x) for x in numbers], np.int64)
        self.sequence = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
        self.begins = np.append(0, np.cumsum(sizes))[:-1]
        self.item_of = np.array(of, np.int32)
        widths = np.minimum(sizes, window)
        self.shortest = int(widths.min(initial=window))
        #: of each width: starts of windows
        self.groups = []
        for width in np.unique(widths).tolist():
            some = np.flatnonzero(widths == width)
            many = sizes[some] - width + 1
            starts = np.repeat(self.begins[some] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            self.groups.append((width, starts.astype(np.int32)))

    def items_at(self, starts: np.ndarray) -> np.ndarray:
        return self.item_of[np.searchsorted(self.begins, starts, side="right") - 1]

    def symbols(self, text: str | None) -> np.ndarray:
        """A text's words as numbers; 0 for words that no phrase holds."""
        tokens = words(text)
        return np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), np.int32, len(tokens))


def _runs(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of phrase words that are long enough to hold a phrase."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], symbols != 0, [0]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= shortest
    return starts[keep], ends[keep]


def search_shard(texts: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each text of a shard: merged spans of words in an occurrence, and the items that occur."""
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    pieces, owner, offset = [], [], []
    for i, symbols in enumerate(texts):
        for a, b in zip(*_runs(symbols, phrases.shortest)):
            pieces += [symbols[a:b], np.zeros(1, np.int32)]
            owner.append(i)
            offset.append(a)
    if not pieces:
        return out
    shard = np.concatenate(pieces)
    run_start = np.append(0, np.cumsum([len(p) + 1 for p in pieces[::2]]))
    index = FMIndex(shard, len(phrases.vocabulary))
    depth = np.zeros(len(shard) + 1, np.int64)
    seen = set()
    for width, all_starts in phrases.groups:
        for begin in range(0, len(all_starts), AT_ONCE):
            starts = all_starts[begin : begin + AT_ONCE]
            low, high = index.search(phrases.sequence, starts, width)
            hit = np.flatnonzero(low < high)
            count, item = high[hit] - low[hit], phrases.items_at(starts[hit])
            for part in _shares(count, 1 << 20):
                times = count[part]
                first = np.repeat(low[hit[part]] - np.append(0, np.cumsum(times)[:-1]), times)
                position = index.locate(first + np.arange(times.sum()))
                np.add.at(depth, position, 1)
                np.add.at(depth, position + width, -1)
                doc = np.asarray(owner)[np.searchsorted(run_start, position, side="right") - 1]
                seen.update(map(tuple, np.unique(np.stack([doc, np.repeat(item[part], times)]), axis=1).T.tolist()))
    covered = np.cumsum(depth)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        run = int(np.searchsorted(run_start, a, side="right")) - 1
        shift = int(offset[run]) - int(run_start[run])
        out[owner[run]][0].append((a + shift, b + shift))
    for d, i in sorted(seen):
        out[d][1].append(phrases.items[i])
    return out


def _shares(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of positions whose sizes add up to about ``most``."""
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield slice(a, b)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    carry: list[str],
    window: int = 13,
    block_words: int = 2_000_000,
    shard_words: int = 3_000_000,
) -> DataFrame:
    """``carry`` columns of each document as the struct ``row``, with ``n_words``, ``n_hit`` (words inside an
    occurrence), ``items`` (ids, as strings, of items with an occurring window) and ``spans`` (merged word
    ranges to remove, end exclusive).

    A window is ``window`` consecutive words of an item; a shorter item is one window, an item without words
    none. Null texts have no words. Repeated rows and repeated item ids are allowed; a null item id is called
    ``null``. An empty benchmark hits nothing, an empty table gives no rows. Other columns are not read.

    Every task indexes shards of about ``shard_words`` words. Words that no item holds cannot be part of an
    occurrence: they and stretches too short for any window are left out of the index. The benchmark is sent
    to the tasks in blocks of about ``block_words`` words, parts of long items apart: 8 bytes a word, and the
    block's vocabulary. Beyond one block the documents are searched once per block, so that neither the driver nor a
    task ever holds more than one.
    """
    tables = Tables(docs.sparkSession)
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string"))
    parts = tables.store(items.mapInArrow(_parts(window), "item_id string, part long, text string, n long"))
    size = parts.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // block_words))
    row = T.StructType([docs.schema[c] for c in carry])
    schema = T.StructType(
        [
            T.StructField("row", row),
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", SPAN),
        ]
    )
    found = docs.select(
        F.struct(*columns(carry)).alias("row"),
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast(SPAN).alias("spans"),
    )
    before = None
    for block in range(blocks):
        some = parts.filter(F.pmod(F.xxhash64("item_id", "part", "text"), F.lit(blocks)) == block).select("item_id", "text")
        phrases = Phrases([(r[0], r[1]) for r in some.collect()], window)  # bounded by block_words
        last = block == blocks - 1
        found = found.mapInArrow(_searcher(docs, phrases, shard_words, last), schema)
        if not last:
            found = tables.store(found)
            if before is not None:
                tables.drop(before)
            before = found
    tables.drop(parts)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("row", "n_words", hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")


def _parts(window: int):
    """Items' words, at most about ``PART`` in a row; every window lies in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                tokens = words(text.as_py())
                starts = [at for at in range(0, len(tokens), PART) if not at or at + window <= len(tokens)]
                pieces = [tokens[at : at + PART + window - 1] for at in starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.as_py()] * len(starts), pa.string()),
                        pa.array(starts, pa.int64()),
                        pa.array([b" ".join(p).decode("utf-8", "surrogatepass") for p in pieces], pa.string()),
                        pa.array([len(p) for p in pieces], pa.int64()),
                    ],
                    names=["item_id", "part", "text", "n"],
                )

    return run


def _searcher(docs: DataFrame, phrases: Phrases, shard_words: int, last: bool):
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        held, texts, total = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                symbols = [phrases.symbols(t) for t in part.column(1).to_pylist()]
                held.append(part.drop_columns(["text"]).append_column("text", pa.nulls(len(part), pa.string())) if last else part)
                texts += symbols
                total += sum(map(len, symbols))
                if total >= shard_words:
                    yield from _found(held, texts, phrases)
                    held, texts, total = [], [], 0
        yield from _found(held, texts, phrases)

    return run


def _found(held: list[pa.RecordBatch], texts: list[np.ndarray], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    result, at = search_shard(texts, phrases), 0
    for part in held:
        n = len(part)
        now = result[at : at + n]
        before_items = part.column(part.schema.get_field_index("items")).to_pylist()
        before_spans = part.column(part.schema.get_field_index("spans")).to_pylist()
        items = [sorted({*old, *new}) if new else old for old, (_, new) in zip(before_items, now)]
        spans = [
            [{"start": a, "end": b} for a, b in _merged([(s["start"], s["end"]) for s in old] + new)]
            for old, (new, _) in zip(before_spans, now)
        ]
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                part.column(part.schema.get_field_index("row")),
                part.column(part.schema.get_field_index("text")),
                pa.array([len(t) for t in texts[at : at + n]], pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, span_type),
            ],
            names=["row", "text", "n_words", "items", "spans"],
        )
        at += n


def contaminated():
    """The rule: some word is hit, and at least one word in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))

"""Repeated passages by sparse suffix arrays.

Suffixes are retained at minimiser positions alone: positions whose hashed word group is the least of a window of
groups, so that equal passages retain equal positions. Retained suffixes whose first words another document has too are
dealt to tasks by these words and sorted there by their text. Neighbours are compared word by word, to the right in the
order of suffixes and to the left in the order of what stands before them; the passages around a position that two
documents hold are read off the two common lengths. A run of suffixes with the same first words that is too long for
one task is dealt to several, and each of these passes on only what its least documents leave open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.shared_files import Tables
from cladeflow.llm.words import WORD_TABLE, hash_bytes, hash_words, mix64

#: Words of a passage; of a word group; groups in a minimiser's window.
PASSAGE, GROUP, WINDOW = 50, 8, 32
#: Words that a passage shares at least with the suffix at the minimiser of its first window.
RIGHT = PASSAGE - WINDOW + 1
#: Suffixes of one run that meet in a task, about; suffixes that are compared at a time, at least.
PIECE, STEP = 32768, 16384
#: Bytes of a word beyond which it is compared by a 128-bit digest, so that no suffix is long.
LONG_WORD = 40


def window_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words, in a time that does not depend on the width."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # shares of lengths 1, 2, 4, ... are joined to the width
    factor, power, length = np.uint64(0x9E3779B97F4A7C15), word_hash, 1
    out, done = None, 0
    with np.errstate(over="ignore"):
        multiplier = factor
        while True:
            if width & length:
                piece = power[done : done + n]
                out = piece.copy() if out is None else out * multiplier + piece
                done += length
            length *= 2
            if length > width:
                break
            power = power[: len(power) - length // 2] * multiplier + power[length // 2 :]
            multiplier = mix64(np.array([multiplier], np.uint64))[0] | np.uint64(1)
    return mix64(out)


#: Low bits of a group's hash that give way to its place, so that the least of a window tells where it stands.
PLACE = np.uint64((1 << 24) - 1)


def least_places(groups: np.ndarray) -> np.ndarray:
    """For each window of word groups, the place of its least one; the leftmost of equals."""
    n = len(groups) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = (groups & ~PLACE) | (np.arange(len(groups), dtype=np.uint64) & PLACE)
    width = 1
    while width < WINDOW:  # the window is a power of two
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    starts = np.arange(n)
    return starts + (((least & PLACE).astype(np.int64) - starts) & int(PLACE))


class Texts:
    """Word hashes of some texts one after another, with the windows of groups that lie within one text."""

    def __init__(self, texts: list[str | None]):
        self.hashed, self.counts = hash_words(texts)
        self.starts = np.append(0, np.cumsum(self.counts))
        self.places = least_places(window_hashes(self.hashed, GROUP))

    def inside(self, width: int) -> np.ndarray:
        """Starts of all stretches of ``width`` words within one text."""
        n = np.maximum(self.counts - width + 1, 0)
        return np.repeat(self.starts[:-1] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def minimisers(hashed: np.ndarray) -> np.ndarray:
    """Positions of minimisers in one text."""
    return np.unique(least_places(window_hashes(hashed, GROUP)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _parts(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows with about ``most`` bytes of text together."""
    sizes = np.array([len(t.as_buffer()) for t in batch.column(1)])
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Retained suffixes: document, position and fingerprint of the first words."""
    for batch in batches:
        for part in _parts(batch):
            texts = Texts(part.column(1).to_pylist())
            found = np.unique(texts.places[texts.inside(GROUP + WINDOW - 1)])
            owner = texts.owner(found)
            whole = found + RIGHT <= texts.starts[owner + 1]
            found, owner = found[whole], owner[whole]
            prints = window_hashes(texts.hashed, RIGHT)[found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array((found - texts.starts[owner]).astype(np.int32)), _signed(prints)],
                names=["doc_id", "position", "suffix"],
            )


def _words(texts: list[str]) -> list[bytes]:
    """Words of all texts one after another; a long word is told by a digest behind a sign that no word has."""
    found = b" ".join(t.encode("utf-8", "surrogatepass") for t in texts).translate(WORD_TABLE).split()
    return [w if len(w) <= LONG_WORD else b"~" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in found]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked suffixes that passages are found by: those passages begin ``least`` to ``most`` words before it. ``right``
    are the words that these passages have from the position on, ``left`` those before it, read backwards."""
    for batch in batches:
        for part in _parts(batch):
            told = part.column(1).to_pylist()
            texts = Texts(told)
            asked = part.column(2)
            row = np.repeat(np.arange(len(part)), asked.value_lengths().to_numpy())
            position, pieces = (asked.flatten().field(c).to_numpy() for c in ("position", "pieces"))
            # rows with one doc_id ask at the positions of one another
            at = texts.starts[row] + position
            start = texts.inside(PASSAGE)
            place = texts.places[start]
            first, last = np.searchsorted(place, at, "left"), np.searchsorted(place, at, "right") - 1
            kept = np.flatnonzero((position < texts.counts[row]) & (last >= first))
            if not len(kept):
                continue
            row, at, position, pieces = row[kept], at[kept], position[kept], pieces[kept]
            least, most = at - start[last[kept]], at - start[first[kept]]
            words = _words(told)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            begins = np.append(0, ends)
            text = b" ".join(words)
            right = [text[x:y] for x, y in zip(begins[at].tolist(), (ends[at + PASSAGE - least - 1] - 1).tolist())]
            left = [text[x : max(x, y - 1)][::-1] for x, y in zip(begins[at - most].tolist(), begins[at].tolist())]
            doc = part.column(0).take(pa.array(row))
            dealt = mix64(mix64(doc.to_numpy().view(np.uint64)) + position.astype(np.uint64)) % pieces.astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    doc,
                    pa.array(position, pa.int32()),
                    pa.array(least, pa.int32()),
                    pa.array(most, pa.int32()),
                    _signed(window_hashes(texts.hashed, RIGHT)[at]),
                    pa.array(dealt.astype(np.int32)),
                    pa.array(pieces > 1),
                    pa.array(left, pa.binary()),
                    pa.array(right, pa.binary()),
                ],
                names=["doc_id", "position", "least", "most", "suffix", "piece", "split", "left", "right"],
            )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes, whole runs of them at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < STEP:
            continue
        whole = pa.concat_batches(held)
        open_run = pc.and_(pc.equal(whole["suffix"], whole["suffix"][-1]), pc.equal(whole["piece"], whole["piece"][-1]))
        cut = int(np.argmax(open_run.to_numpy(zero_copy_only=False)))
        if cut:
            yield _agreements(whole.slice(0, cut))
        held = [whole.slice(cut)]
    if held and sum(map(len, held)):
        yield _agreements(pa.concat_batches(held))


def _numbered(texts: pa.Array, width: int) -> tuple[np.ndarray, pa.Array]:
    """Words of each text as numbers, -1 behind the last, and the words."""
    lists = pc.split_pattern(texts, b" ")
    words = pc.dictionary_encode(lists.flatten())
    out = np.full((len(texts), width), -1, np.int32)
    out[np.arange(width) < lists.value_lengths().to_numpy()[:, None]] = words.indices.to_numpy()
    return out, words.dictionary


def _common(numbers: np.ndarray) -> np.ndarray:
    """How many words each text begins with that the one before it begins with, 0 for the first."""
    unlike = (numbers[1:] != numbers[:-1]) | (numbers[1:] < 0)
    return np.append(0, np.where(unlike.any(1), unlike.argmax(1), numbers.shape[1]))


def _marks(numbers: np.ndarray, words: pa.Array, side: int) -> list[np.ndarray]:
    """Two hashes of each number of first words, 0 to all."""
    # the left of a suffix at the beginning of its passage is empty, and its one word is not asked for
    hashed, _ = hash_bytes(b" ".join(w or b"0" for w in words.to_pylist()))
    place = np.arange(numbers.shape[1], dtype=np.uint64) + np.uint64(64 * side + 1)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        each = mix64(hashed[numbers] ^ mix64(place * np.uint64(salt)))
        out.append(np.concatenate([np.zeros((len(each), 1), np.uint64), np.cumsum(each, 1, dtype=np.uint64)], 1))
    return out


def _agreements(runs: pa.RecordBatch) -> pa.RecordBatch:
    """For each suffix of whole runs, starts of the passages around it that another document of its run holds, and whether
    a lesser one does. Where a run is split, the passages of which no lesser document is here are left open."""
    doc, position, least, most = (runs[c].to_numpy() for c in ("doc_id", "position", "least", "most"))
    split = runs["split"].to_numpy(zero_copy_only=False)
    right, right_words = _numbered(runs["right"], PASSAGE)
    left, left_words = _numbered(runs["left"], WINDOW)
    common_right = _common(right)
    common_right[1:][np.diff(runs["suffix"].to_numpy()) != 0] = 0
    common_right[1:][np.diff(runs["piece"].to_numpy()) != 0] = 0
    by_left = pc.sort_indices(runs["left"]).to_numpy()
    common_left = _common(left[by_left])
    split_row = np.cumsum(split) - 1
    marks = [_marks(n[split], w, side) for side, (n, w) in enumerate([(left, left_words), (right, right_words)])] if split.any() else []
    found, unknown = [], []
    same_left = np.empty(len(doc), np.int64)
    for before in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= before) & (before <= most))
        same_right = np.cumsum(common_right < PASSAGE - before)
        same_left[by_left] = np.cumsum(common_left < before)
        passage = same_right[rows] * (len(doc) + 1) + same_left[rows]
        order = np.argsort(passage, kind="stable")
        rows, passage = rows[order], passage[order]
        edge = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(rows) else np.empty(0, np.int64)
        if not len(edge):
            continue
        sizes = np.diff(np.append(edge, len(rows)))
        low, high = (np.repeat(f.reduceat(doc[rows], edge), sizes) for f in (np.minimum, np.maximum))
        later = doc[rows] > low
        told = (low < high) & (later | ~split[rows])
        found.append((rows[told], position[rows[told]] - before, later[told]))
        asks = split[rows] & ~later
        if asks.any():
            at = split_row[rows[asks]]
            one, two = (marks[0][k][at, before] + marks[1][k][at, PASSAGE - before] + np.uint64(before) for k in (0, 1))
            unknown.append((rows[asks], position[rows[asks]] - before, one.view(np.int64), two.view(np.int64), high[asks]))
    row, start, later = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    by_row = np.argsort(row, kind="stable")
    offsets = pa.array(np.searchsorted(row[by_row], np.arange(len(doc) + 1)), pa.int32())
    starts = pa.ListArray.from_arrays(offsets, pa.array(start[by_row], pa.int32()))
    laters = pa.ListArray.from_arrays(offsets, pa.array(later[by_row].astype(bool)))
    row, *open_columns = (np.concatenate(c) for c in zip(*unknown)) if unknown else (np.empty(0, np.int64),) * 5
    by_row = np.argsort(row, kind="stable")
    offsets = pa.array(np.searchsorted(row[by_row], np.arange(len(doc) + 1)), pa.int32())
    kinds = {"start": pa.int32(), "one": pa.int64(), "two": pa.int64(), "high": pa.int64()}
    fields = [pa.array(c[by_row], kind) for c, kind in zip(open_columns, kinds.values())]
    opens = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, list(kinds)))
    out = pa.RecordBatch.from_arrays([runs["doc_id"], starts, laters, opens], names=["doc_id", "starts", "later", "opens"])
    return out.filter(pc.or_(pc.greater(pc.list_value_length(starts), 0), pc.greater(pc.list_value_length(opens), 0)))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans of a document's repeated passages, and of those first found in an earlier document."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        repeated, removed = [], []
        for starts, later in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            starts = np.array(starts)
            order = np.argsort(starts, kind="stable")
            starts, later = starts[order], np.array(later, bool)[order]
            repeated.append(_merge(starts))
            removed.append(_merge(starts[later]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(repeated, kind), pa.array(removed, kind)], names=["doc_id", "repeated", "removed"])


def _merge(starts: np.ndarray) -> list[dict[str, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > PASSAGE)
    first, last = np.append(starts[0], starts[cut + 1]), np.append(starts[cut], starts[-1])
    return [{"start": int(a), "end": int(b) + PASSAGE} for a, b in zip(first, last)]


def repeated_passages(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per document that holds a passage of 50 words or more which another document holds too: ``doc_id``,
    ``repeated`` (word ranges of all such passages, end exclusive), ``removed`` (those that a document with a lesser
    id holds too, so that the first keeps its own), ``n_repeated`` and ``n_removed`` (words in them).

    Exact: a word is in ``repeated`` if and only if it lies in 50 consecutive words that occur in two documents. Words are
    compared as they are (those of over 40 bytes by 128 bits), but for passages around suffixes that more than about 32,768
    others begin like, which tasks tell one another by 128 bits. Rows with one doc_id are one document, and a null
    ``doc_id`` takes no part; null and short texts hold no passage. Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    suffixes = docs.mapInArrow(_suffixes, "doc_id long, position int, suffix long")
    # suffixes that begin like one of another document
    runs = suffixes.groupBy("suffix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    runs = runs.filter("low < high").select("suffix", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    anchors = suffixes.join(runs, "suffix").groupBy("doc_id").agg(F.collect_set(F.struct("position", "pieces")).alias("asked"))
    asked = docs.join(anchors, "doc_id").select("doc_id", "text", "asked")
    kind = "doc_id long, position int, least int, most int, suffix long, piece int, split boolean, left binary, right binary"
    ordered = asked.mapInArrow(_contexts, kind).repartition("suffix", "piece").sortWithinPartitions("suffix", "piece", "right")
    opens = "array<struct<start:int,one:bigint,two:bigint,high:bigint>>"
    walked = Tables(docs.sparkSession).store(ordered.mapInArrow(_walk, f"doc_id long, starts array<int>, later array<boolean>, opens {opens}"))
    left_open = walked.select("doc_id", F.explode("opens").alias("o")).select("doc_id", "o.*")
    ends = left_open.groupBy("one", "two").agg(F.min("doc_id").alias("low"), F.max("high").alias("high")).filter("low < high")
    closed = left_open.drop("high").join(ends, ["one", "two"])
    closed = closed.select("doc_id", F.array("start").alias("starts"), F.array(F.col("doc_id") > F.col("low")).alias("later"))
    found = walked.filter("size(starts) > 0").select("doc_id", "starts", "later").union(closed)
    found = found.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("later")).alias("later"))
    kind = "array<struct<start:bigint,end:bigint>>"
    spans = found.mapInArrow(_spans, f"doc_id long, repeated {kind}, removed {kind}")
    length = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return spans.select("doc_id", length("repeated").alias("n_repeated"), length("removed").alias("n_removed"), "repeated", "removed")

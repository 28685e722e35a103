"""Substring dedup: MinHash bands of paragraphs, exact verification, connected components.

The bands of a paragraph are the least hashes of its set of shingles (a bottom-k MinHash, one hash a band), as many as its
size needs: of two sets with a Jaccard similarity of 0.8 or more, at least one of the first fifth and one more is in
both. Sets of ``CAPPED`` shingles and more have ``MOST`` bands, which miss a pair at the threshold with a chance of 1e-7. Sets of fewer than
four shingles are near copies of equal sets alone, and have none.

Within a band's bucket, members by size come apart where one is over 1.25 times as large as the one before. Members of a
crowded bucket are joined in another exact way, by their rarest shingles: lines of one boilerplate that differ in more than a
near copy may meet in every band, but share nothing rare.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm.collisions import link
from cladeflow.llm.components import connected_components
from cladeflow.llm.jaccard_join import Sets, shared_counts
from cladeflow.llm.shared_files import Tables
from cladeflow.llm.words import hash_bytes, mix64, shingle_hashes, slices

WIDTH, THRESHOLD = 5, 0.8
#: Bands of the largest sets; members of a bucket that are compared as they are.
MOST, CROWD = 10, 32
CAPPED = 5 * MOST - 5
#: Sizes of a class lie within this factor. Most frequent shingles that tasks know, and about how many are counted at a time.
CLASS, KNOWN, RANGE = 1.05, 1 << 20, 1 << 19
#: Words of a repeated stretch that are a passage: of 50 words that repeat, those of a sentence cut at either end are not found.
PASSAGE = 25
#: The end of a sentence and the white space after it that stays in the line, as UTF-8.
SENTENCE = re.compile(
    rb"[.!?](?:[\t\v\f\r\x1c-\x1f ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)+"
)


class Units:
    """The lines of some texts and, of lines of several sentences, their sentences, where they hold a word: ``owner`` (a text's
    place), ``ranges`` (code points of that text), ``begin`` and ``words`` (a stretch of ``hashed``), ``before`` (words of that text
    before it), by owner and start."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join([*texts, b""])
        blanks = np.array([m.span() for m in SENTENCE.finditer(data)], np.int64).reshape(-1, 2)
        blanks[:, 0] += 1
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
        starts = np.append(0, ends + 1)[:-1]
        starts, ends = starts[ends > starts], ends[ends > starts]
        first, last = np.sort(np.append(starts, blanks[:, 1])), np.sort(np.append(blanks[:, 0], ends))
        first, last = first[last > first], last[last > first]
        several = np.searchsorted(first, ends) - np.searchsorted(first, starts) > 1
        inner = several[np.searchsorted(starts, first, side="right") - 1]
        starts, ends = np.append(starts, first[inner]), np.append(ends, last[inner])
        text_starts = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        points = None
        if not data.isascii():
            raw = np.frombuffer(data, np.uint8)
            points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
            # white space beyond ASCII would join the words on either side
            changed = bytearray(data)
            for a, b in blanks[points[blanks[:, 1]] - points[blanks[:, 0]] < blanks[:, 1] - blanks[:, 0]].tolist():
                changed[a:b] = b" " * (b - a)
            data = bytes(changed)
        self.hashed, at = hash_bytes(data)
        begin = np.searchsorted(at, starts)
        words = np.searchsorted(at, ends) - begin
        order = np.argsort(starts, kind="stable")
        order = order[words[order] > 0]
        self.begin, self.words = begin[order], words[order]
        starts, ends = starts[order], ends[order]
        self.owner = np.searchsorted(text_starts, starts, side="right") - 1
        self.before = self.begin - np.searchsorted(at, text_starts)[self.owner]
        origin = text_starts[self.owner]
        if points is not None:
            starts, ends, origin = points[starts], points[ends], points[origin]
        self.ranges = np.stack([starts - origin, ends - origin], 1).astype(np.int32)

    def sets(self, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Sets of hashed shingles of some units, in rising order one after another, and where each one's begin."""
        begin, words = self.begin[some], self.words[some]
        sizes = np.maximum(words - WIDTH + 1, 1)
        starts = np.append(0, np.cumsum(sizes))
        inside = np.repeat(begin - starts[:-1], sizes) + np.arange(starts[-1])
        whole = shingle_hashes(self.hashed, WIDTH)
        shingles = whole[np.minimum(inside, len(whole) - 1)]
        for width in range(1, WIDTH):  # fewer words than a shingle has are one shingle
            of = np.flatnonzero(words == width)
            if len(of):
                shingles[starts[of]] = shingle_hashes(self.hashed, width)[begin[of]]
        _sort_each(shingles, starts, sizes)
        new = np.ones(len(shingles), bool)
        new[1:] = shingles[1:] != shingles[:-1]
        new[starts[:-1]] = True
        return shingles[new], np.append(0, np.cumsum(new))[starts]


def _sort_each(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Sorts every stretch by itself: those of one size together, as rows."""
    order = np.argsort(sizes, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(sizes[order], prepend=-1)), len(order))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        size = int(sizes[order[a]])
        if b - a == 1:
            values[starts[order[a]] : starts[order[a]] + size].sort()
        elif size > 1:
            places = starts[order[a:b], None] + np.arange(size)
            values[places] = np.sort(values[places], axis=1)


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def _keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each unit's set of shingles."""
    return np.add.reduceat(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)), starts[:-1]).view(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units, numbered in each document, with the bands of their sets; of equal sets, one's bands are enough."""
    for batch in batches:
        for part in slices(batch, 1):
            units = Units(_bytes(part.column(1)))
            owner = units.owner
            if not len(owner):
                continue
            shingles, starts = units.sets()
            keys, sizes = _keys(shingles, starts), np.diff(starts)
            number = np.arange(len(owner)) - np.searchsorted(owner, owner)
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            many = np.where(first & (sizes > 3), np.minimum(sizes // 5 + 1, MOST), 0)
            ends = np.append(0, np.cumsum(many))
            inside = np.repeat(starts[:-1] - ends[:-1], many) + np.arange(ends[-1])
            bands = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(shingles[inside].view(np.int64)))
            numbers = [pa.array(x.astype(np.int32)) for x in (number, *units.ranges.T, units.before, units.words)]
            ids = [part.column(c).take(pa.array(owner)) for c in (0, 2)]
            columns = [*ids, *numbers, pa.array(keys), pa.array(sizes.astype(np.int32)), bands]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "number", "start", "end", "before", "words", "key", "size", "bands"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by shingle, size and key: those of which another key of like size has the shingle, with their bucket. One
    row is held back, as the next may join it. The first and the last shingle may go on in other tasks: all their rows
    stay, and a row without a key names them."""
    held, opening, lone = None, None, []
    for batch in batches:
        shingle, size, key = (batch.column(c).to_numpy() for c in range(3))
        joined, least = False, -1
        if held is not None:
            shingle, size, key = (np.append(h, x) for h, x in zip(held[:3], (shingle, size, key)))
            joined, least = held[3:]
        if not len(key):
            continue
        opening = shingle[0] if opening is None else opening
        new = np.ones(len(key), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])
        shingle, size, key = shingle[new], size[new].astype(np.int64), key[new]
        tied = np.zeros(len(key) + 1, bool)
        tied[0] = joined
        tied[1:-1] = (shingle[1:] == shingle[:-1]) & (4 * size[1:] <= 5 * size[:-1])
        start = np.maximum.accumulate(np.where(tied[:-1], 0, np.arange(len(key))))
        lowest = size[start]
        if joined:
            lowest[start == 0] = least
        met = (tied[:-1] | tied[1:] | (shingle == opening))[:-1]
        yield _joined(shingle[:-1][met], lowest[:-1][met], key[:-1][met])
        # rows by themselves of the shingle at hand: as sizes rise by a quarter from each to the next, a few
        last = np.flatnonzero(~met & (shingle[:-1] == shingle[-1]))
        lone = [x for x in lone if x[0] == shingle[-1]] + [(shingle[i], lowest[i], key[i]) for i in last.tolist()]
        held = shingle[-1], size[-1], key[-1], tied[-2], lowest[-1]
    if held is not None:
        yield _joined(*(np.array(x) for x in zip(*lone, (held[0], held[4], held[2]))))
        ends = pa.array([opening, held[0]], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.int64()), ends, pa.nulls(2, pa.int64())], names=["key", "shingle", "bucket"])


def _joined(shingle: np.ndarray, lowest: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    bucket = mix64(shingle.view(np.uint64) ^ mix64(lowest.view(np.uint64) + np.uint64(1)))
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, shingle, bucket)], names=["key", "shingle", "bucket"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the units with the numbers that are asked for; of rows with one doc_id, of each."""
    for batch in batches:
        for part in slices(batch, 0):
            units = Units(_bytes(part.column(0)))
            asked, every = part.column(1), np.arange(len(part))
            first, end = np.searchsorted(units.owner, every), np.searchsorted(units.owner, every, side="right")
            lengths = asked.value_lengths().to_numpy()
            some = np.repeat(first, lengths) + asked.flatten().to_numpy()
            some = some[some < np.repeat(end, lengths)]
            if len(some):
                shingles, starts = units.sets(some)
                data, ends = shingles.tobytes(), (8 * starts).tolist()
                sets = pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_keys(shingles, starts)), sets], names=["key", "shingles"])


def _counted(parts: int):
    """Different shingles of a batch of sets with their counts, a row for each of ``parts`` ranges of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1 << 22):
                shingle, n = np.unique(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint64), return_counts=True)
                range_ = (shingle >> np.uint64(48)).astype(np.int64) * parts >> 16
                cuts = np.append(np.flatnonzero(np.diff(range_, prepend=-1)), len(range_)).tolist()
                data = [[x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])] for x in (shingle.view(np.int64), n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(range_[cuts[:-1]]), *(pa.array(x, pa.binary()) for x in data)], names=["part", "shingles", "counts"])

    return run


def _frequent(limit: int):
    """Of the shingles of one range, those in more than ``limit`` sets."""

    def run(table: pa.Table) -> pa.Table:
        shingle, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("shingles", "counts"))
        order = np.argsort(shingle, kind="stable")
        new = np.flatnonzero(np.diff(shingle[order], prepend=~shingle[order[:1]]))
        shingle, n = shingle[order][new], np.add.reduceat(n[order], new)
        return pa.table({"shingles": [shingle[n > limit].tobytes()], "counts": [n[n > limit].tobytes()]})

    return run


def _first_fifths(known: np.ndarray, counts: np.ndarray):
    """Rows for the first fifth of every set, in an order in which frequent shingles, which are ``known``, follow the others by
    their ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data = part.column(1).to_pylist()
                sizes = np.array([len(x) // 8 for x in data])
                every, shingle = np.repeat(np.arange(len(part)), sizes), np.frombuffer(b"".join(data), np.int64)
                at = np.searchsorted(known, shingle)
                n = np.where(known[at] == shingle, counts[at], 0)
                order = np.lexsort((shingle, n, every))
                place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = place <= sizes[every] // 5
                order, place = order[first], place[first]
                every = every[order]
                numbers = [pa.array(x.astype(np.int32)) for x in (sizes[every], place)]
                columns = [part.column(0).take(pa.array(every)), *numbers, pa.array(shingle[order]), pa.array(n[order] > 0)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "place", "shingle", "frequent"])

    return run


def _rarest(sets: DataFrame, tables: Tables) -> DataFrame:
    """Buckets ``key``, ``bucket``, ``probe`` in which every two of the sets at 0.8 or more meet, one of them no probe: the first
    shingle that two sets share, in an order from rare to frequent, leaves enough after it in either set to reach 0.8 with
    the other's size. What many sets share comes last in the order, so that sets alike by nothing else don't meet. In buckets
    of frequent shingles sizes are in classes, and a set is a probe in classes below its own; the others are small.

    Frequent are shingles of more than ``CROWD`` sets, and more where over ``KNOWN`` would be; they go to the tasks with
    their counts. To count, sets meet as blocks of a range of shingles, each with its count in a block, and no shingle becomes
    a row but those of the first fifths."""
    sets = tables.store(sets.select("key", "shingles"))
    total = int(sets.agg(F.sum(F.length("shingles")) / 8).first()[0] or 0)
    blocks = sets.select("shingles").mapInArrow(_counted(total // RANGE + 1), "part long, shingles binary, counts binary")
    found = blocks.groupBy("part").applyInArrow(_frequent(max(CROWD, total // KNOWN)), "shingles binary, counts binary").collect()
    known, counts = (np.frombuffer(b"".join(r[c] for r in found), np.int64) for c in (0, 1))
    order = np.argsort(known)
    known, counts = np.append(known[order], 2**63 - 1), np.append(counts[order], 0)
    placed = sets.mapInArrow(_first_fifths(known, counts), "key long, size int, place int, shingle long, frequent boolean")
    placed = placed.withColumn("most", F.expr("9 * (size - place) div 4 - size")).withColumn("least", F.expr("(4 * size + 4) div 5"))
    of = lambda c: F.floor(F.log(c) / math.log(CLASS)).cast("int")
    classes = F.when(F.col("frequent"), F.sequence(of("least"), F.least(of("size"), of("most")))).otherwise(F.array(F.lit(-1)))
    placed = placed.filter("most >= least").select("key", "shingle", "frequent", of("size").alias("mine"), F.explode(classes).alias("class"))
    return placed.select("key", F.xxhash64("shingle", "class").alias("bucket"), (F.col("frequent") & (F.col("class") < F.col("mine"))).alias("probe"))


def _prepare(data: dict[str, list]) -> Sets:
    return Sets(data["shingles"])


def _compare(sets: Sets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    left, right = sets.sizes[a], sets.sizes[b]
    yes = np.zeros(len(a), bool)
    live = np.flatnonzero(4 * np.maximum(left, right) <= 5 * np.minimum(left, right))
    if len(live):
        shared = shared_counts(sets, a[live], b[live])
        yes[live] = shared >= THRESHOLD * (left[live] + right[live] - shared) - 1e-9
    return yes


def _sized(rows: DataFrame) -> DataFrame:
    """Members of buckets of two or more, as groups with their sizes ``n`` and ``probes``; buckets with the same members count once."""
    probes = F.count_if("probe")
    marks = [(F.count("*") - probes).alias("n"), probes.alias("probes"), F.bit_xor(F.xxhash64("key", "probe")).alias("marks"), F.min("key").alias("least")]
    alike = rows.groupBy("bucket").agg(*marks).filter("n > 0 and n + probes > 1")
    alike = alike.groupBy("n", "probes", "marks", "least").agg(F.min("bucket").alias("group"))
    return rows.join(alike.select(F.col("group").alias("bucket"), "n", "probes"), "bucket").withColumnRenamed("bucket", "group")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """One row per paragraph of which another document has a near copy: ``doc_id``, ``start`` and ``end`` (code points of the
    text), ``class_id`` (the least doc_id of its component) and ``removed`` (it is not in that document).

    Paragraphs are every line with a word and, where a line has several sentences, every sentence with a word, whatever their
    lengths; ranges of a line and of its sentences overlap. Near copies have sets of five-word shingles with a Jaccard
    similarity of 0.8 or more; fewer than five words are one shingle. Components of such pairs are classes. A paragraph that
    only its own document repeats is not reported. Rows with one doc_id are one document, a null ``doc_id`` takes no
    part; null and empty texts hold nothing to report. Equal sets of shingles are told by a hash of 64 bits. Other
    columns are not read; an empty table gives no rows.
    """
    return _repeated(docs).select("doc_id", "start", "end", "class_id", "removed")


def sized_paragraphs(docs: DataFrame) -> DataFrame:
    """:func:`repeated_paragraphs` with how much of a document's text repeats in one piece there: ``words`` of the paragraph,
    ``passage_words`` of the stretch of repeated paragraphs, with no word between them, that it is in, and ``passage``, true where
    these are ``PASSAGE`` or more. Many documents share a line of a word or two; those with a true ``passage`` share more."""
    by = Window.partitionBy("doc_id", "text_hash")
    reach = F.max(F.col("before") + F.col("words")).over(by.orderBy("before", "words").rowsBetween(Window.unboundedPreceding, -1))
    found = _repeated(docs).withColumn("apart", F.coalesce((F.col("before") > reach).cast("int"), F.lit(0)))
    found = found.withColumn("stretch", F.sum("apart").over(by.orderBy("before", "words").rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "text_hash", "stretch")
    found = found.withColumn("passage_words", F.max(F.col("before") + F.col("words")).over(whole) - F.min("before").over(whole))
    return found.select("doc_id", "start", "end", "class_id", "removed", "words", "passage_words", (F.col("passage_words") >= PASSAGE).alias("passage"))


def _repeated(docs: DataFrame) -> DataFrame:
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    kind = "doc_id long, text_hash long, number int, start int, end int, before int, words int, key long, size int, bands array<long>"
    marked = tables.store(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_marked, kind))
    members = marked.filter("size(bands) > 0").select(F.explode("bands").alias("shingle"), "size", "key")
    members = members.repartitionByRange("shingle", "size", "key").sortWithinPartitions("shingle", "size", "key")
    met = tables.store(members.mapInArrow(_met, "key long, shingle long, bucket long"))
    # shingles at the ends of tasks, at most two a task: their rows meet whatever their sizes
    ends = met.filter("key is null").select("shingle", F.lit(True).alias("at_end")).distinct()
    rows = met.filter("key is not null").join(F.broadcast(ends), "shingle", "left")
    rows = rows.select("key", "shingle", F.when(F.col("at_end"), F.xxhash64("shingle")).otherwise(F.col("bucket")).alias("bucket"))
    near = tables.store(rows)
    tables.drop(met)
    units = tables.store(marked.drop("size", "bands"))
    tables.drop(marked)
    places = units.join(near.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id", "number")).alias("place"))
    asked = tables.store(places.groupBy("place.doc_id").agg(F.collect_list("place.number").alias("asked")))
    sets = docs.join(asked, "doc_id").select("text", "asked").mapInArrow(_sets, "key long, shingles binary")
    payload = tables.store(sets.dropDuplicates(["key"]).select("key", F.lit(1).cast("long").alias("copies"), "shingles"))
    tables.drop(asked)
    crowded = near.groupBy("bucket").count().filter(F.col("count") > CROWD).select("bucket")
    crowd = near.join(crowded, "bucket", "left_semi").select("key").distinct()
    rarest = _rarest(payload.join(crowd, "key", "left_semi"), tables)
    groups = near.join(crowded, "bucket", "left_anti").select("key", "bucket", F.lit(False).alias("probe")).unionByName(rarest)
    groups = tables.store(_sized(groups))
    tables.drop(near)
    found = tables.store(link(groups, payload, _prepare, _compare, "long", count=False))
    tables.drop(groups, payload)
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), tables)
    tables.drop(found)
    tied = roots.select(F.col("id").alias("key"), "root").union(roots.select(F.col("root").alias("key"), "root").distinct())
    keys = units.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
    keys = tables.store(keys.join(tied, "key", "left").filter("least < last or root is not null"))
    classes = keys.filter("root is not null").groupBy("root").agg(F.min("least").alias("class_least"), F.max("last").alias("class_last"))
    named = keys.join(classes, "root", "left")
    named = named.select("key", F.coalesce("class_least", "least").alias("class_id"), F.coalesce("class_last", "last").alias("last"))
    named = tables.store(named.filter("class_id < last").select("key", "class_id"))
    tables.drop_all(keep=(units, named))
    return units.join(named, "key").withColumn("removed", F.col("doc_id") != F.col("class_id"))

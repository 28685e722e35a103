"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Texts that collide in a band of MinHash values, and whose lowest bits of all values leave the threshold possible, are tied to
candidate groups. In a group, MinHash values are compared a few at a time; a pair goes when the posterior probability
that its similarity reaches the threshold, under a uniform prior, falls below a tolerance. The shingle sets of the
rest are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.collisions import candidate_groups, candidate_ties, link
from cladeflow.llm.components import connected_components
from cladeflow.llm.shared_files import Tables
from cladeflow.llm.words import hash_words, mix64, shingle_hashes

WIDTH, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with a chance of (1 - 0.8 ** 4) ** 32, or 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
TOLERANCE = 1e-7
#: The same for the lowest bits of all values; a bit of two unlike values is equal by chance half of the time.
BIT_THRESHOLD, BIT_TOLERANCE = (1 + THRESHOLD) / 2, 1e-9
#: MinHash values that are compared at a time.
STEP = 16
#: Most sets whose elements become one 0/1 matrix, and elements of a matrix.
MATRIX, ELEMENTS = 1024, 4096
#: Elements of pairs of sets that are compared at once.
GATHERED = 1 << 20
#: Steps of a product that take as long as gathering an element.
GATHER_COST = 600


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """Least value of each of ``HASHES`` hash functions over a set of hashed shingles."""
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * _multipliers()
        part >>= np.uint64(32)
        np.minimum(least, part.min(0).astype(np.uint32), out=least)
    return least


@lru_cache
def needed_matches(threshold: float, tolerance: float) -> list[int]:
    """For each n: the fewest equal values of n with which a pair's posterior probability of reaching the
    threshold is ``tolerance`` or more. It is the chance of at most m successes in n + 1 draws."""
    out = []
    for n in range(HASHES + 1):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out.append(m)
                break
    return out


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Hashed shingles of each text, sorted, each once; a text of fewer words is one shingle."""
    hashed, counts = hash_words(texts)
    every, at = shingle_hashes(hashed, width), 0
    for n in counts.tolist():
        yield np.unique(every[at : at + n - width + 1] if n >= width else shingle_hashes(hashed[at : at + n], width))
        at += n


def _key(found: np.ndarray) -> bytes | None:
    """Names a set: equal keys of 128 bits are taken for equal sets."""
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            found = list(shingle_sets(part.column(1).to_pylist()))
            marks = [minhash(x).tobytes() if len(x) else None for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(_key, found), pa.binary()), pa.array(marks, pa.binary())], names=["doc_id", "key", "signature"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            found = list(shingle_sets(batch.column(0).slice(at, 256).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_key, found), pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["key", "shingles"]
            )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of a signature, with the lowest bits of all values."""
    for batch in batches:
        for at in range(0, len(batch), 2048):
            keys, signature = batch.column(0).slice(at, 2048), _values(batch.column(1).slice(at, 2048).to_pylist())
            sketch = np.packbits((signature & 1).astype(np.uint8), axis=1)
            bucket = np.zeros((len(keys), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(ROWS):
                bucket = mix64(bucket ^ signature[:, k::ROWS].astype(np.uint64)) + np.uint64(k)
            of = pa.array(np.repeat(np.arange(len(keys)), BANDS))
            sketches = pa.array([x.tobytes() for x in sketch], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), keys.take(of), sketches.take(of)], names=["bucket", "key", "sketch"])


def _values(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, HASHES)


class Sets:
    """Sorted sets of 64-bit values one after another, with a number for each value."""

    def __init__(self, data: list[bytes]):
        self.sizes = np.array([len(x) // 8 for x in data], np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))
        distinct, self.numbers = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)
        self.many = len(distinct)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in the sets at ``rows``, and to which place in ``rows`` each belongs."""
        sizes = self.sizes[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        first = self.starts[rows] - np.append(0, np.cumsum(sizes)[:-1])
        return self.numbers[np.repeat(first, sizes) + np.arange(len(owner))], owner


def shared_counts(sets: Sets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``a[i]`` and ``b[i]``."""
    used = np.unique(np.concatenate([a, b]))
    # gathering takes time for each element of each pair, a product for each element of every two sets
    if GATHER_COST * (sets.sizes[a] + sets.sizes[b]).sum() <= len(used) ** 2 * sets.sizes[used].sum():
        out = np.zeros(len(a), np.int64)
        group = np.cumsum(sets.sizes[a] + sets.sizes[b]) // GATHERED
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(a)]
        for low, high in zip(edges, edges[1:]):
            if high > low:
                (x, x_of), (y, y_of) = sets.of(a[low:high]), sets.of(b[low:high])
                # a pair and a number in one: both sides are sorted
                x, y = x_of * sets.many + x, y_of * sets.many + y
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                out[low:high] = np.bincount(y_of[x[at] == y], minlength=high - low)
        return out
    if len(used) > MATRIX:  # pairs of one meeting stand together: parts have fewer sets
        half = len(a) // 2
        return np.concatenate([shared_counts(sets, a[:half], b[:half]), shared_counts(sets, a[half:], b[half:])])
    # many pairs of few sets: products of 0/1 matrices over ranges of the elements
    numbers, owner = sets.of(used)
    elements, inverse = np.unique(numbers, return_inverse=True)
    left, left_at = np.unique(np.searchsorted(used, a), return_inverse=True)
    right, right_at = np.unique(np.searchsorted(used, b), return_inverse=True)
    product = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(elements), ELEMENTS):
        inside = (inverse >= low) & (inverse < low + ELEMENTS)
        bits = np.zeros((len(used), min(ELEMENTS, len(elements) - low)), np.float32)
        bits[owner[inside], inverse[inside] - low] = 1
        product += bits[left] @ bits[right].T
    return product[left_at, right_at].astype(np.int64)


def _prepare(data: dict[str, list]) -> tuple[np.ndarray, Sets, list[int]]:
    return _values(data["signature"]), Sets(data["shingles"]), needed_matches(THRESHOLD, TOLERANCE)


def _compare(data: tuple[np.ndarray, Sets, list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    signature, sets, needed = data
    live, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, HASHES, STEP):
        part = slice(at, at + STEP)
        equal[live] += (signature[a[live], part] == signature[b[live], part]).sum(1)
        live = live[equal[live] >= needed[at + STEP]]
    yes = np.zeros(len(a), bool)
    if len(live):
        shared = shared_counts(sets, a[live], b[live])
        union = sets.sizes[a[live]] + sets.sizes[b[live]] - shared
        yes[live] = shared >= THRESHOLD * union - 1e-9
    return yes


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the least doc_id in its component of links) and ``n_links`` (other
    documents with a similarity of 0.8 or more).

    Similarity is the Jaccard similarity of sets of five-word shingles; a text of fewer words is one shingle. A text
    without words, or null, links with nothing and is its own class. Documents with equal sets are one class from
    the start and count as often as they stand there, so do repeated rows. A null ``doc_id`` is kept; a class of
    nulls alone has a null id. Other columns are not read; an empty table gives no rows.
    """
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = tables.store(docs.mapInArrow(_signatures, "doc_id long, key binary, signature binary"))
    usable = marked.filter("key is not null").groupBy("key")
    classes = tables.store(usable.agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("signature").alias("signature")))
    members = classes.select("key", "signature").mapInArrow(_members, "bucket long, key binary, sketch binary")
    ties = candidate_ties(members, needed_matches(BIT_THRESHOLD, BIT_TOLERANCE)[HASHES], tables)
    groups = tables.store(candidate_groups(ties, tables))
    wanted = classes.join(groups.select("key"), "key", "left_semi").select("least", "key", "copies", "signature")
    asked = docs.join(wanted.select("least"), docs["doc_id"].eqNullSafe(F.col("least")), "left_semi").select("text")
    sets = tables.store(asked.mapInArrow(_sets, "key binary, shingles binary"))
    payload = wanted.drop("least").join(sets, "key").dropDuplicates(["key"])
    found = tables.store(link(groups, payload, _prepare, _compare, "binary"))
    totals = found.groupBy("key").agg(F.sum("linked").alias("linked"))
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), tables)
    placed = classes.join(roots, classes["key"] == roots["id"], "left").select("key", "least", "copies", F.coalesce("root", "key").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    placed = placed.join(names, "root").join(totals, "key", "left")
    placed = tables.store(placed.select("key", "class_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    alone = marked.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    tables.drop_all(keep=(marked, placed))
    return marked.select("doc_id", "key").join(placed, "key").select("doc_id", "class_id", "n_links").unionByName(alone)

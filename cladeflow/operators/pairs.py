"""Pairs of taxa and pairs of sites.

The joins on cells say what is meant and suit small alignments. ``blocked_distances`` and ``blocked_site_pairs`` give the same
tables for large ones: rows are packed into blocks, every two blocks of an alignment meet in one task, and numpy
compares them, so that the cells of a pair never become rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cladeflow.functions import bounds as b
from cladeflow.plans.storage import checkpointed


def taxon_pairs(cells: DataFrame) -> DataFrame:
    """Cells of every two taxa at each site: ``i``, ``j``, ``mask_i``, ``mask_j`` and the site's ``weight``."""
    cells = cells if "weight" in cells.columns else cells.withColumn("weight", F.lit(1).cast("long"))
    a = cells.select("aln_id", "site", F.col("taxon").alias("i"), F.col("mask").alias("mask_i"), "weight")
    b = cells.select("aln_id", "site", F.col("taxon").alias("j"), F.col("mask").alias("mask_j"))
    return a.join(b, ["aln_id", "site"]).filter(F.col("i") < F.col("j"))


def _disjoint() -> Column:
    return F.col("mask_i").bitwiseAND(F.col("mask_j")) == 0


def fitch_distances(cells: DataFrame) -> DataFrame:
    """``dist``: weight of sites where the states are disjoint; ``strict``: where they differ; ``sites``: disjoint sites, once each."""
    differ = F.col("mask_i") != F.col("mask_j")
    return taxon_pairs(cells).groupBy("aln_id", "i", "j").agg(
        F.coalesce(F.sum(F.when(_disjoint(), F.col("weight"))), F.lit(0)).alias("dist"),
        F.coalesce(F.sum(F.when(differ, F.col("weight"))), F.lit(0)).alias("strict"),
        F.count_if(_disjoint()).alias("sites"),
    )


def distinguishing_sites(cells: DataFrame) -> DataFrame:
    """Rows of two taxa and a site that tells them apart."""
    return taxon_pairs(cells).filter(_disjoint()).select("aln_id", "i", "j", "site")


def site_pairs(cells: DataFrame) -> DataFrame:
    """``mask16`` of every two sites: bit 4 * c + d is on if some taxon shows bases c and d there. Unambiguous cells only."""
    code = F.bit_count(F.col("mask") - 1)
    clear = cells.filter(F.bit_count("mask") == 1)
    a = clear.select("aln_id", "taxon", F.col("site").alias("p"), code.alias("c"))
    b = clear.select("aln_id", "taxon", F.col("site").alias("q"), code.alias("d"))
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(16)]), 4 * F.col("c") + F.col("d") + 1)
    pairs = a.join(b, ["aln_id", "taxon"]).filter(F.col("p") < F.col("q"))
    return pairs.groupBy("aln_id", "p", "q").agg(F.bit_or(bit).alias("mask16"))


def pair_surplus(cells: DataFrame) -> DataFrame:
    """Joint states of two sites beyond what the sites need alone: n_pq - n_p - n_q + 1."""
    own = cells.groupBy("aln_id", "site").agg(F.countDistinct("mask").alias("n"))
    a = cells.select("aln_id", "taxon", F.col("site").alias("p"), F.col("mask").alias("s"))
    b = cells.select("aln_id", "taxon", F.col("site").alias("q"), F.col("mask").alias("t"))
    both = a.join(b, ["aln_id", "taxon"]).filter(F.col("p") < F.col("q"))
    both = both.groupBy("aln_id", "p", "q").agg(F.countDistinct("s", "t").alias("n_pq"))
    both = both.join(own.select("aln_id", F.col("site").alias("p"), F.col("n").alias("n_p")), ["aln_id", "p"])
    both = both.join(own.select("aln_id", F.col("site").alias("q"), F.col("n").alias("n_q")), ["aln_id", "q"])
    return both.select("aln_id", "p", "q", (F.col("n_pq") - F.col("n_p") - F.col("n_q") + 1).alias("surplus"))


def farthest_pair(distances: DataFrame) -> DataFrame:
    """The pair of largest ``dist``, of equals the one with least i, then j; and how many are equal."""
    best = distances.groupBy("aln_id").agg(F.max("dist").alias("dist"))
    ties = distances.join(best, ["aln_id", "dist"])
    return ties.groupBy("aln_id", "dist").agg(F.min(F.struct("i", "j")).alias("first"), F.count("*").alias("n_ties")).select("aln_id", "first.i", "first.j", "dist", "n_ties")


def cross_minimum(distances: DataFrame) -> DataFrame:
    """For each rank ``r`` from 1: the least distance between a taxon before ``r`` and one from ``r`` on.

    A pair (i, j) lies across all ranks i + 1 .. j. Two runs of 2^k ranks, which may overlap, cover these, so that a pair is two rows
    whatever its width, and partial minima leave a row for each k and rank. A run's minimum then goes to its halves, k after k."""
    wide = F.floor(F.log2((F.col("j") - F.col("i")).cast("double")) + F.lit(1e-9)).cast("int")
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))
    starts = F.explode(F.array(F.col("i") + 1, F.col("j") - step + 1))
    runs = distances.select("aln_id", "i", "j", "dist", wide.alias("k")).select("aln_id", "k", starts.alias("r"), "dist")
    runs = checkpointed(runs.groupBy("aln_id", "k", "r").agg(F.min("dist").alias("min_dist")))
    most = runs.agg(F.max("k")).first()[0] or 0
    level = runs.filter(F.col("k") == most).drop("k")
    for k in range(most, 0, -1):
        halves = F.explode(F.array(F.col("r"), F.col("r") + (1 << (k - 1))))
        level = level.select("aln_id", halves.alias("r"), "min_dist").unionByName(runs.filter(F.col("k") == k - 1).drop("k"))
        level = level.groupBy("aln_id", "r").agg(F.min("min_dist").alias("min_dist"))
    return level.select("aln_id", "r", "min_dist")


def relabelled(rows: DataFrame, order: DataFrame, rank: str = "rank") -> DataFrame:
    """Ranks back to taxa by ``order`` (aln_id, rank, taxon)."""
    names = order.select("aln_id", F.col("rank").alias(rank), "taxon")
    return rows.join(names, ["aln_id", rank])


def _packed(cells: DataFrame, row: str, column: str) -> DataFrame:
    """Rows as binary strings of one byte per column, and the columns' weights where ``cells`` has any, else null."""
    weighted = "weight" in cells.columns
    held = F.array_sort(F.collect_list(F.struct(column, "mask", *["weight"] * weighted)))
    rows = cells.groupBy("aln_id", F.col(row).cast("long").alias("id")).agg(held.alias("held"))
    weights = F.transform("held", lambda c: c["weight"].cast("long")) if weighted else F.lit(None).cast("array<long>")
    rows = rows.select("aln_id", "id", F.transform("held", lambda c: c["mask"].cast("int")).alias("masks"), weights.alias("weights"))

    def run(batches):
        for batch in batches:
            masks = batch.column("masks")
            sizes = np.append(0, np.cumsum(masks.value_lengths().to_numpy())).astype(np.int32)
            values = masks.flatten().to_numpy().astype(np.uint8)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("aln_id"), batch.column("id"), packed, batch.column("weights")], names=["aln_id", "id", "masks", "weights"])

    return rows.mapInArrow(run, "aln_id string, id long, masks binary, weights array<long>")


def packed_rows(cells: DataFrame) -> DataFrame:
    """Taxa (``id``) with their ``masks``, a byte for each site in order."""
    return _packed(cells, "taxon", "site")


#: Rows of one block, by their ids: the ids, and the masks as a matrix.
Block = tuple[np.ndarray, np.ndarray]


def _met(rows: DataFrame, block: int, compare: Callable[[int, int, Block, Block, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """``compare`` gets the numbers of every two blocks of an alignment, or of a block twice, both blocks and the columns' weights, and gives
    the columns of ``schema`` after ``aln_id``. Blocks are dealt by order of ids, so that those of a lower one are less. Weights go with the first row of a block; pairs of
    blocks are dealt to tasks by number, as few bytes can be much work."""
    context = rows.sparkSession.sparkContext
    number = F.row_number().over(W.Window.partitionBy("aln_id").orderBy("id")) - 1
    rows = rows.withColumn("number", number).withColumn("mine", F.floor(F.col("number") / block).cast("int"))
    rows = rows.withColumn("weights", F.when(F.col("number") % block == 0, F.col("weights")))
    blocks = F.max("mine").over(W.Window.partitionBy("aln_id"))
    rows = rows.withColumn("last", blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select("aln_id", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "id", "mine", "masks", "weights")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key, table):  # two blocks at most
        low, high = key[1].as_py(), key[2].as_py()
        ids, mine = (table.column(c).to_numpy() for c in ("id", "mine"))
        masks = np.frombuffer(b"".join(table.column("masks").to_pylist()), np.uint8).reshape(len(ids), -1)
        given = table.column("weights").drop_null()
        weights = np.array(given[0].as_py(), np.int64) if len(given) else np.ones(masks.shape[1], np.int64)
        sides = []
        for k in (low, high):
            at = np.flatnonzero(mine == k)
            at = at[np.argsort(ids[at])]
            sides.append((ids[at], masks[at]))
        values = compare(low, high, *sides, weights)
        return pa.Table.from_arrays([pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(values[0])), *map(pa.array, values)], names=["aln_id", *names])

    dealt = rows.repartition(max(4 * context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "aln_id", "low", "high")
    return dealt.groupBy("aln_id", "low", "high").applyInArrow(run, f"aln_id string, {schema}")


Pairs = Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def _blocked(rows: DataFrame, block: int, compare: Pairs, names: list[str]) -> DataFrame:
    """A row for every two ids i < j with what ``compare`` tells of them."""

    def pairs(low, high, one, two, weights):
        values = compare(one[1], two[1], weights)
        if low < high:
            return [np.repeat(one[0], len(two[0])), np.tile(two[0], len(one[0])), *(v.ravel() for v in values)]
        i, j = np.triu_indices(len(one[0]), 1)
        return [one[0][i], one[0][j], *(v[i, j] for v in values)]

    return _met(rows, block, pairs, ", ".join(f"{n} long" for n in ["i", "j", *names]))


def _apart(x: np.ndarray, y: np.ndarray, weights: np.ndarray, strict: bool = False) -> np.ndarray:
    """Weight of the columns in which the states of two rows are disjoint or, with ``strict``, differ. A column counts where one row has a
    value and the other a value apart from it: of all values and columns, one product. Whole numbers stay exact in it."""
    out = np.zeros((len(x), len(y)), np.float32 if weights.sum() < 1 << 24 else np.float64)
    for at in range(0, x.shape[1], 1024):
        a, b, w = x[:, at : at + 1024], y[:, at : at + 1024], weights[at : at + 1024].astype(out.dtype)
        values = np.unique(a)
        left = np.concatenate([(a == v) * w for v in values], axis=1)
        right = np.concatenate([(b != v) if strict else (b & v) == 0 for v in values], axis=1).astype(out.dtype)
        out += left @ right.T
    return out


def blocked_distances(cells: DataFrame, block: int = 1024) -> DataFrame:
    """``dist`` and ``strict`` of ``fitch_distances`` for alignments in which every taxon has a cell at every site."""

    def compare(x, y, weights):
        dist = _apart(x, y, weights).astype(np.int64)
        clear = not any((m & (m - 1)).any() for m in (x, y))  # single bases are disjoint where they differ
        return [dist, dist if clear else _apart(x, y, weights, strict=True).astype(np.int64)]

    return _blocked(_packed(cells, "taxon", "site"), block, compare, ["dist", "strict"])


def blocked_farthest_pair(cells: DataFrame, block: int = 4096) -> DataFrame:
    """``farthest_pair`` by ``dist``, for alignments without gaps in the grid. Of every two blocks one row is told: their farthest pair and
    how many are equal."""

    def compare(low, high, one, two, weights):
        best, first, ties = -1, (0, 0), 0
        for at in range(0, len(one[0]), 512):
            dist = _apart(one[1][at : at + 512], two[1], weights)
            if low == high:
                dist[np.arange(len(dist))[:, None] + at >= np.arange(len(two[0]))[None]] = -1
            most = dist.max()
            if most >= max(best, 0):
                i, j = divmod(int(dist.argmax()), len(two[0]))
                if most > best:
                    best, first, ties = most, (one[0][at + i], two[0][j]), 0
                ties += int((dist == most).sum())
        return [np.array([x] if ties else [], np.int64) for x in (int(best), *first, ties)]

    found = _met(_packed(cells, "taxon", "site"), block, compare, "dist long, i long, j long, n_ties long")
    told = found.groupBy("aln_id", "dist").agg(F.min(F.struct("i", "j")).alias("first"), F.sum("n_ties").alias("n_ties"))
    most = told.groupBy("aln_id").agg(F.max(F.struct("dist", "first", "n_ties")).alias("m"))
    return most.select("aln_id", "m.first.i", "m.first.j", "m.dist", "m.n_ties")


def blocked_cross_minimum(cells: DataFrame, block: int = 1024) -> DataFrame:
    """``cross_minimum`` by ``dist`` for each taxon ``r`` but the first, for alignments without gaps in the grid. A pair of blocks gives a row for each
    taxon in either, and one least distance for all blocks that lie between them."""
    far = np.iinfo(np.int64).max

    def compare(low, high, one, two, weights):
        dist = _apart(one[1], two[1], weights).astype(np.int64)
        if low == high:
            # least over rows up to one and columns from one on
            dist[np.tril_indices(len(dist))] = far
            least = np.minimum.accumulate(np.minimum.accumulate(dist, axis=0)[:, ::-1], axis=1)[:, ::-1]
            value = np.append(far, least[np.arange(len(dist) - 1), np.arange(1, len(dist))])
            return [one[0], np.full(len(dist), low), np.full(len(dist), low), np.zeros(len(dist), bool), value]
        head, tail = np.minimum.accumulate(dist.min(1))[:-1], np.minimum.accumulate(dist.min(0)[::-1])[::-1]
        own = np.repeat([low, high], [len(head), len(tail)])
        ends = [np.append(own, low + 1), np.append(own, high - 1)]
        return [np.concatenate([one[0][1:], two[0], [-1]]), *ends, np.append(own < 0, True), np.concatenate([head, tail, [dist.min()]])]

    found = checkpointed(_met(_packed(cells, "taxon", "site"), block, compare, "r long, first long, last long, between boolean, min_dist long"))
    at = F.col("first").alias("block")
    within = found.filter("not between").groupBy("aln_id", at, "r").agg(F.min("min_dist").alias("min_dist"))
    across = found.filter("between and first <= last").select("aln_id", F.explode(F.sequence("first", "last")).alias("block"), "min_dist")
    across = across.groupBy("aln_id", "block").agg(F.min("min_dist").alias("over"))
    both = within.join(across, ["aln_id", "block"], "left").withColumn("min_dist", F.least("min_dist", "over"))
    return both.filter(F.col("min_dist") < far).select("aln_id", "r", "min_dist")


def blocked_spanning_edges(cells: DataFrame, strict: bool = False, block: int = 2048) -> DataFrame:
    """Edges (i, j, dist) among which each alignment has a minimum spanning tree of its taxa, for alignments without gaps in the grid: of
    the distances within a block a spanning tree, of those between two blocks another. Every distance is in one of these graphs, so
    that what is left out is no less than a way of edges that stay."""

    def compare(low, high, one, two, weights):
        dist = _apart(one[1], two[1], weights, strict)
        edges = b.spanning_edges(dist) if low == high else b.spanning_edges_between(dist)
        w, i, j = np.array(edges, np.int64).reshape(-1, 3).T
        return [one[0][i], two[0][j], w]

    return _met(_packed(cells, "taxon", "site"), block, compare, "i long, j long, dist long")


def blocked_site_pairs(cells: DataFrame, block: int = 256) -> DataFrame:
    """``mask16`` of ``site_pairs`` (columns ``i`` and ``j`` are the sites), for alignments without gaps in the grid."""

    def compare(x, y, weights):
        out = np.zeros((len(x), len(y)), np.int64)
        for c, s in enumerate((1, 2, 4, 8)):
            for d, t in enumerate((1, 2, 4, 8)):
                out |= (((x == s).astype(np.float32) @ (y == t).astype(np.float32).T) > 0).astype(np.int64) << (4 * c + d)
        return [out]

    found = _blocked(_packed(cells, "site", "taxon"), block, compare, ["mask16"])
    return found.select("aln_id", F.col("i").alias("p"), F.col("j").alias("q"), F.col("mask16").cast("int").alias("mask16")).filter("mask16 <> 0")


def _elimination() -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of bases at two sites show a common base at the first, and at the second, without being the same."""
    x, y = np.divmod(np.arange(225), 15)
    other = ~np.eye(225, dtype=bool)
    return tuple((((v[:, None] + 1) & (v[None] + 1) != 0) & other).astype(np.float32) for v in (x, y))


def blocked_incompatible(cells: DataFrame, block: int = 64) -> DataFrame:
    """``incompatible`` for every two sites p < q of an alignment, ambiguous states included, for alignments without gaps in the grid.

    Joint states that share no base with another on one side go, until none does; more than two are left if the sites are incompatible.
    The joint states of all pairs of two blocks of sites are one matrix, and a round of elimination is two products with it."""

    def compare(x, y, weights):
        first, second = _elimination()
        held = np.zeros((len(x) * len(y), 225), np.float32)
        pair = np.arange(len(held))
        for a, b in zip(x.T.astype(np.int64), y.T.astype(np.int64)):
            held[pair, ((a[:, None] - 1) * 15 + b[None] - 1).ravel()] = 1
        live = pair
        while len(live):
            some = held[live]
            kept = some * ((some @ first) > 0) * ((some @ second) > 0)
            changed = (kept != some).any(1)
            held[live] = kept
            live = live[changed]
        return [(held.sum(1) > 2).astype(np.int64).reshape(len(x), len(y))]

    found = _blocked(_packed(cells, "site", "taxon"), block, compare, ["incompatible"])
    return found.select("aln_id", F.col("i").alias("p"), F.col("j").alias("q"), (F.col("incompatible") == 1).alias("incompatible"))

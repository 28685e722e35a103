"""Whitening of embeddings by the eigenvectors of a covariance that comes from variances alone.

Polarisation: the tasks sum exact squared centred values of every dimension and of the sum of every two dimensions;
Var(a + b) - Var(a) - Var(b) is twice the covariance of a and b. All sums are integers, so that they are exact and the same
in any order. Values are centred by whole numbers next to the means; what these leave over is known from the first pass
and taken off exactly. A task holds a batch of rows and one sum for each two dimensions, and so does the driver, which
assembles the matrix: memory depends on the dimensions, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.llm.shared_files import Tables

SCALE, SHIFT = 64, 1_000_000
#: Larger values are no longs after scaling.
LARGEST = 1 << 62
LIMB = 10**18
#: Rows that are compared at once; sums that a task holds before it gives them out.
ROWS, HELD = 4096, 1 << 20


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a batch, for each length of vectors: which rows are usable, and their scaled values as longs."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    offsets = column.offsets.to_numpy()[:-1]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * values[offsets[some][:, None] + np.arange(size)])
                usable = (np.abs(x) < LARGEST - SHIFT).all(1)  # false for what is not finite
            if usable.any():
                yield some[usable], x[usable].astype(np.int64) + SHIFT


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """Values as they are if no sum of so many of them, each at most ``most``, leaves a long; as Python integers otherwise."""
    return x if most * max(len(x), 1) < LARGEST else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _limbs(sums: list[tuple[int, int, int]]) -> pa.RecordBatch:
    parts = [divmod(v, LIMB) for _, _, v in sums]
    wide = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), pa.array([Decimal(h) for h, _ in parts], wide), pa.array([Decimal(lo) for _, lo in parts], wide)],
        names=["size", "place", "high", "low"],
    )


def _summed(vectors: DataFrame, per_batch) -> DataFrame:
    """Adds up ``per_batch(values)`` (a list of Python integers) over all usable rows of a length, exactly: ``high`` times 10^18
    and ``low`` for each place."""

    def run(batches):
        held: dict[int, list[int]] = {}
        give = lambda: _limbs([(size, k, v) for size, sums in held.items() for k, v in enumerate(sums)])
        for batch in batches:
            for _, x in _vectors(batch.column(0)):
                more, size = per_batch(x), x.shape[1]
                held[size] = [a + b for a, b in zip(held[size], more)] if size in held else more
                if len(held) > 1 and sum(map(len, held.values())) > HELD:
                    yield give()
                    held.clear()
        if held:
            yield give()

    parts = vectors.mapInArrow(run, "size long, place long, high decimal(38,0), low decimal(38,0)")
    return parts.groupBy("size", "place").agg(F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low"))


def _told(sums: DataFrame) -> dict[int, int]:
    return {r["place"]: int(r["high"]) * LIMB + int(r["low"]) for r in sums.collect()}


class Whitening:
    """The fit: ``n`` vectors of ``size`` entries, their sums, the covariance's eigenvectors and eigenvalues by falling value."""

    def __init__(self, n: int, sums: list[int], components: int):
        self.n, self.sums, self.components = n, sums, min(components, len(sums))
        self.centre = [(2 * s + n) // (2 * n) for s in sums]
        self.rest = [s - n * c for s, c in zip(sums, self.centre)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array(self.centre, np.int64)

    def squares(self, x: np.ndarray) -> list[int]:
        """Sums of the squares of every dimension, and of the sum of every two."""
        d = self.centred(x)
        most = _largest(d)
        d = _exact(d, 4 * most * most)
        out = (d * d).sum(0).tolist()
        for i in range(d.shape[1] - 1):
            both = d[:, i : i + 1] + d[:, i + 1 :]
            both *= both
            out += both.sum(0).tolist()
        return out

    def decompose(self, squares: dict[int, int]) -> None:
        size, n, rest = len(self.sums), self.n, self.rest
        variance = [n * squares[i] - rest[i] ** 2 for i in range(size)]  # n^2 times the variance
        v = np.zeros((size, size))
        place = size
        for i in range(size):
            v[i, i] = variance[i] / n**2
            for j in range(i + 1, size):
                both = n * squares[place] - (rest[i] + rest[j]) ** 2
                v[i, j] = v[j, i] = (both - variance[i] - variance[j]) / (2 * n**2)
                place += 1
        self.trace = sum(variance) / n**2
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][: self.components], vectors[:, ::-1][:, : self.components]
        largest = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
        self.values, self.vectors = values, vectors * np.where(largest < 0, -1.0, 1.0)
        #: Directions in which the vectors vary at all, as far as doubles tell.
        self.real = values > max(float(values[0]), 0.0) * size * np.finfo(float).eps
        self.explained = [max(float(e), 0.0) / self.trace if self.trace > 0 else None for e in values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        exact = self.centred(x) - np.array(self.rest, np.float64) / self.n
        return (exact @ self.vectors[:, self.real]) / np.sqrt(self.values[self.real])

    def deviations(self, x: np.ndarray) -> list[int]:
        d = self.centred(x)
        most = (_largest(d) * self.n + max(map(abs, self.rest), default=0)) ** 2
        if most * max(len(self.sums), 1) >= LARGEST:
            d = d.astype(object)
        d = d * self.n - np.array(self.rest, d.dtype)
        return (d * d).sum(1).tolist()


def fit_whitening(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """From the one column of ``vectors``, arrays of doubles. None if no vector is usable."""
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession)

    def first(x: np.ndarray) -> list[int]:
        return [len(x), *(int(s) for s in _exact(x, _largest(x)).sum(0))]

    sums = tables.store(_summed(vectors, first))
    usual = sums.filter("place = 0").orderBy(F.desc("high"), F.desc("low"), F.desc("size")).select("size").first()
    if usual is None:
        tables.drop(sums)
        return None
    size = usual["size"]
    found = _told(sums.filter(F.col("size") == size))
    tables.drop(sums)
    fit = Whitening(found[0], [found[k + 1] for k in range(size)], components)
    fit.decompose(_told(_summed(vectors.filter(F.size(F.col(vectors.columns[0])) == size), fit.squares)))
    return fit


def identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, as they come out, less the identity."""
    size, k = len(fit.sums), int(fit.real.sum())

    def run(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _vectors(batch.column(0)):
                if x.shape[1] == size:
                    z = fit.whitened(x)
                    total += z.sum(0)
                    square += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([total, square.ravel()]))], names=["place", "value"])

    if not k:
        return 0.0
    sums = {r["place"]: r["value"] for r in vectors.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}
    mean = np.array([sums[i] for i in range(k)]) / fit.n
    square = np.array([sums[k + i] for i in range(k * k)]).reshape(k, k) / fit.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 32) -> DataFrame:
    """A row for each usable vector of ``column`` and each of the first ``components``: ``key``, ``component`` from 1, the number
    ``n`` of vectors fitted, the exact squared ``deviation`` of the vector, its ``whitened`` value, the share of the variance
    ``explained``, and the ``identity_error`` of the whole.

    Vectors that are null or empty, hold null or non-finite entries, or entries that are no longs after scaling, have no rows; nor
    have vectors of another length than most (of equally many the longer). Keys may be null or repeat. Where the vectors do not
    vary in a direction (one vector, equal vectors, fewer vectors than entries), its ``whitened`` is null, and ``explained`` too if they vary in none. A
    deviation beyond a long is null. An empty table gives none. Columns other than the two are not read."""
    doubles = table.select(F.col(column).cast("array<double>").alias("v"))
    schema = T.StructType(
        [
            T.StructField(key, table.schema[key].dataType),
            *[T.StructField(name, kind) for name, kind in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))],
        ]
    )
    fit = fit_whitening(doubles, components)
    if fit is None:
        return table.sparkSession.createDataFrame([], schema)
    error, size, k = identity_error(doubles, fit), len(fit.sums), fit.components

    def run(batches):
        for batch in batches:
            for rows, x in _vectors(batch.column(1)):
                if x.shape[1] != size:
                    continue
                n = len(rows)
                z = np.full((n, k), np.nan)
                z[:, fit.real] = fit.whitened(x)
                deviation = pa.array([d if d < 1 << 63 else None for d in fit.deviations(x)], pa.int64())
                each = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows[each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, fit.n)),
                        deviation.take(pa.array(each)),
                        pa.array(z.ravel(), mask=np.tile(~fit.real, n)),
                        pa.array(fit.explained * n, pa.float64()),
                        pa.array(np.full(n * k, error)),
                    ],
                    names=schema.names,
                )

    keyed = table.select(F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v"))
    return keyed.mapInArrow(run, schema)



import numpy as np
import pytest

from cladeflow.llm import whitening
from cladeflow.llm.whitening import fit_whitening, whiten


def told(frame, **settings):
    rows = whiten(frame, **settings).collect()
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def check(spark, vectors, others=(), kind="float", components=32):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([(*r, "clash", 3) for r in [*rows, *others]], f"vec_id long, embedding array<{kind}>, component string, n int").repartition(3)
    got = told(frame, components=components)
    values = np.array(vectors, np.float32 if kind == "float" else np.float64).astype(float)
    x = np.floor(64 * values).astype(np.int64) + 1_000_000
    n, sums = len(x), [int(s) for s in x.astype(object).sum(0)]
    exact = np.array([[n * int(a) - s for a, s in zip(row, sums)] for row in x], object)
    v = (exact.T @ exact).astype(float) / float(n) ** 3
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert set(got) == set(range(n))
    k = min(components, x.shape[1])
    for i in range(n):
        assert sorted(got[i]) == list(range(1, k + 1))
        assert all(r["n"] == n and r["deviation"] == sum(d * d for d in exact[i]) for r in got[i].values())
    z = np.array([[got[i][c]["whitened"] for c in range(1, k + 1)] for i in range(n)], float)
    error = np.abs(np.cov(z.T, bias=True).reshape(k, k) - np.eye(k)).max()
    expected = exact.astype(float) / n @ u[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        sign = np.sign(expected[:, c] @ z[:, c])
        assert np.allclose(sign * z[:, c], expected[:, c], atol=1e-7)
        assert all(abs(got[i][c + 1]["explained"] - e[c] / np.trace(v)) < 1e-9 for i in range(n))
    assert error < 1e-8 and all(abs(r["identity_error"] - error) < 1e-8 for g in got.values() for r in g.values())


def test_equals_direct_covariance(spark):
    draw = np.random.default_rng(5)
    mixing = draw.standard_normal((6, 6))
    odd = [(100, None), (101, []), (102, [float("nan")] * 6), (103, [float("inf")] + [0.0] * 5), (104, [None] + [1.0] * 5), (105, [1.0, 2.0]), (106, [1e30] * 6)]
    check(spark, draw.standard_normal((80, 6)) @ mixing, odd)
    check(spark, draw.standard_normal((50, 6)) @ mixing + 7, odd, "double", 3)


def test_many_batches_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 7)
    draw = np.random.default_rng(6)
    check(spark, draw.standard_normal((60, 3)) * 1000)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(draw.standard_normal((20, 2)) * 2.0**50)], "vec_id long, embedding array<double>")
    rows = whiten(frame).collect()  # sums of squares beyond a long stay exact; what no long holds is null
    assert len(rows) == 40 and all(r["deviation"] is None and abs(r["identity_error"]) < 1e-8 for r in rows)


def test_sums_are_exact(spark):
    frame = spark.createDataFrame([([2.0**50 + k],) for k in range(5)], "v array<double>")
    fit = fit_whitening(frame)
    assert fit.n == 5 and fit.sums == [sum(64 * (2**50 + k) + 1_000_000 for k in range(5))]
    assert fit.values[0] == pytest.approx(64**2 * 2.0)


def test_directions_without_variance(spark):
    for vectors, real in (([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 3, 0), ([[1.0, 2.0], [3.0, 2.0]], 1)):
        rows = whiten(spark.createDataFrame([(None, v) for v in vectors], "vec_id long, embedding array<float>")).collect()
        assert len(rows) == 2 * len(vectors)
        assert sum(r["whitened"] is not None for r in rows) == real * len(vectors) and all(r["identity_error"] < 1e-9 for r in rows)


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, [])]):
        out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

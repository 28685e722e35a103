"""Work on all pairs of taxa in blocks, against tables of pairs; blocks are far smaller than the alignments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions import bounds as b
from cladeflow.operators import pairs
from cladeflow.operators.spanning import spanning_weights
from cladeflow.plans.storage import checkpointed, dropped


@pytest.fixture(scope="module")
def cells(spark):
    draw, rows = np.random.default_rng(51), []
    for name, n, most, step in (("one", 1, 16, 1), ("two", 2, 16, 1), ("many", 23, 16, 7), ("alike", 17, 3, 3), ("equal", 9, 2, 1)):
        masks, weights = draw.integers(1, most, (n, 6)), draw.integers(1, 9, 6)
        rows += [(name, s, 5 + step * t, int(masks[t, s]), int(weights[s])) for t in range(n) for s in range(6)]
    return checkpointed(spark.createDataFrame(rows, "aln_id string, site long, taxon long, mask int, weight long").repartition(3))


def sorted_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_distances_and_what_is_told_of_them(cells):
    told = checkpointed(pairs.fitch_distances(cells))
    columns = ["aln_id", "i", "j", "dist", "strict"]
    assert sorted_rows(pairs.blocked_distances(cells, 4), *columns) == sorted_rows(told, *columns)
    columns = ["aln_id", "i", "j", "dist", "n_ties"]
    assert sorted_rows(pairs.blocked_farthest_pair(cells, 4), *columns) == sorted_rows(pairs.farthest_pair(told), *columns)
    taxa = cells.select("aln_id", F.col("taxon").alias("r")).distinct()
    across = told.join(taxa, "aln_id").filter("i < r and r <= j").groupBy("aln_id", "r").agg(F.min("dist").alias("min_dist"))
    for block in (1, 4, 100):
        assert sorted_rows(pairs.blocked_cross_minimum(cells, block), "aln_id", "r", "min_dist") == sorted_rows(across, "aln_id", "r", "min_dist")


@pytest.mark.parametrize("strict", [False, True])
def test_few_edges_hold_a_spanning_tree(cells, strict):
    edges = checkpointed(pairs.fitch_distances(cells).select("aln_id", "i", "j", F.col("strict" if strict else "dist").alias("dist")))
    few = checkpointed(pairs.blocked_spanning_edges(cells, strict, 8))
    assert few.count() < edges.count()
    assert sorted_rows(spanning_weights(few, ["aln_id"]), "aln_id", "weight") == sorted_rows(spanning_weights(edges, ["aln_id"]), "aln_id", "weight")


def test_a_tree_between_two_blocks_equals_that_of_the_whole_matrix():
    draw = np.random.default_rng(52)
    for n, m, most in ((1, 1, 3), (1, 6, 3), (7, 1, 3), (9, 12, 4), (30, 20, 1000)):
        between = draw.integers(0, most, (n, m)).astype(float)
        whole = np.full((n + m, n + m), 1e6)
        whole[:n, n:], whole[n:, :n] = between, between.T
        edges = b.spanning_edges_between(between)
        assert len(edges) == n + m - 1 and all(between[i, j] == w for w, i, j in edges)
        assert sum(w for w, _, _ in edges) == b.spanning_tree(whole)


def test_stored_tables_don_t_pass_on_estimates(spark):
    """With Spark's checkpoints the estimated size has about twice the digits after every join."""
    df = spark.range(20).toDF("a")
    for _ in range(8):
        later = checkpointed(df.join(df.withColumnRenamed("a", "b"), F.col("a") == F.col("b")).select("a"))
        if _:
            dropped(df)
        df = later
    assert df.count() == 20 and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20

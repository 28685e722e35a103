import numpy as np

from cladeflow.functions import bounds as b
from cladeflow.operators.spanning import spanning_trees, spanning_weights


def test_equals_prim_on_many_graphs(spark):
    draw = np.random.default_rng(31)
    rows, expected = [], {}
    for g, (n, most) in enumerate([(2, 5), (3, 1), (9, 3), (30, 4), (40, 1000)]):
        m = np.triu(draw.integers(0, most + 1, (n, n)), 1)
        m = m + m.T
        rows += [("g", g, i, j, int(m[i, j])) for i in range(n) for j in range(i + 1, n)]
        expected["g", g] = b.spanning_tree(m)
    table = spark.createDataFrame(rows, "aln_id string, first int, i long, j long, dist long").repartition(5)
    assert {(r["aln_id"], r["first"]): r["weight"] for r in spanning_weights(table, ["aln_id", "first"]).collect()} == expected
    edges = spanning_trees(table, ["aln_id", "first"]).collect()
    assert len(edges) == len(set(edges)) == 1 + 2 + 8 + 29 + 39


def test_a_long_chain_forests_loops_and_repeats(spark):
    # weights rise along the chain, so that every node takes the edge before it
    chain = [("c", i, i + 1, 10 + i) for i in range(70)]
    other = [("c", 200, 201, 3), ("c", 201, 200, 3), ("c", 200, 201, 9), ("c", 5, 5, 0)]
    table = spark.createDataFrame(chain + other, "aln_id string, i long, j long, dist long")
    found = spanning_trees(table, ["aln_id"])
    assert sorted((r["i"], r["j"], r["dist"]) for r in found.collect()) == sorted([(i, j, d) for _, i, j, d in chain] + [(200, 201, 3)])


def test_empty_table(spark):
    table = spark.createDataFrame([], "aln_id string, i long, j long, dist long")
    assert spanning_trees(table, ["aln_id"]).count() == 0 and spanning_weights(table, ["aln_id"]).count() == 0

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions import fitch, newick
from cladeflow.operators import trees
from tests.test_trees_numpy import MASKS, ONES, every_tree


@pytest.fixture(scope="module")
def patterns(spark):
    draw = np.random.default_rng(4)
    rows = [("quick", i, [int(x) for x in MASKS[:, i]], 1) for i in range(4)]
    rows += [("five", i, [int(x) for x in draw.integers(1, 16, 5)], int(draw.integers(1, 4))) for i in range(9)]
    return spark.createDataFrame(rows, "aln_id string, site long, states array<int>, weight long")


def matrix(patterns, name):
    rows = sorted(patterns.filter(F.col("aln_id") == name).collect(), key=lambda r: r["site"])
    return np.array([r["states"] for r in rows], np.uint8).T, np.array([r["weight"] for r in rows])


def test_enumeration_and_pruned_search(spark, patterns):
    every, counters = trees.search(patterns)
    scores = {r["aln_id"]: (r["n"], r["least"]) for r in every.groupBy("aln_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect()}
    masks, weights = matrix(patterns, "five")
    least = min(fitch.length(t, masks, weights) for t in every_tree(5))
    assert scores == {"quick": (945, 6), "five": (15, least)}
    upper = spark.createDataFrame([("quick", 6), ("five", least)], "aln_id string, upper long")
    pruned, fewer = trees.search(patterns, upper)
    best = trees.shortest(every)
    told = lambda x: {(r["aln_id"], tuple(r["parents"])) for r in x.collect()}
    assert told(pruned) == told(best) and sum(a == "quick" for a, _ in told(best)) == 210
    assert fewer.agg(F.sum("kept")).first()[0] < counters.agg(F.sum("kept")).first()[0]
    assert trees.shortest(every, 3).groupBy("aln_id", "missed").count().filter("aln_id = 'quick' and missed and count = 3").count() == 1


def test_waves_find_the_same_trees_and_store_less(spark, patterns):
    told = lambda x: {(r["aln_id"], tuple(r["parents"])) for r in x.collect()}
    every, counters = trees.search(patterns)
    found, fewer = trees.search(patterns, wave=40)
    assert told(trees.shortest(found)) == told(trees.shortest(every)) and found.count() < every.count()
    rows = {(r["aln_id"], r["level"]): r for r in counters.collect()}
    assert [rows["quick", k]["tried"] for k in range(3, 8)] == [1, 3, 15, 105, 945] and all(r["pruned"] == 0 for r in rows.values())
    assert (rows["quick", 7]["full"], rows["quick", 7]["ties"], rows["quick", 6]["full"], rows["quick", 6]["ties"]) == (945, 210, 0, 0)
    less = {(r["aln_id"], r["level"]): r for r in fewer.collect()}
    assert all(r["tried"] == r["kept"] + r["pruned"] for r in less.values()) and less["quick", 7]["kept"] < 945 and less["quick", 7]["ties"] == 210


def test_scores_views_and_places(spark, patterns):
    some = [("five", i, t) for i, t in enumerate(every_tree(5))]
    table = spark.createDataFrame(some, "aln_id string, tree_id long, parents array<int>")
    masks, weights = matrix(patterns, "five")
    for size in (4096, 2):
        got = {r["tree_id"]: r["length"] for r in trees.score_trees(table, patterns, size).collect()}
        assert got == {i: fitch.length(t, masks, weights) for _, i, t in some}
    short = spark.createDataFrame([("five", 0, every_tree(4)[1])], "aln_id string, tree_id long, parents array<int>")
    costs = trees.placements(short, patterns, 2)
    down, up, _ = fitch.views(every_tree(4)[1], masks[:4], weights)
    expected = fitch.insertion_costs(down, up, masks[4], weights)
    assert {r["edge"]: r["cost"] for r in costs.collect()} == {e: int(expected[e]) for e in range(1, 6)}
    assert trees.best_places(costs).first()["cost"] == min(expected[1:])
    seen = trees.edge_views(short, patterns, 5).filter("block = 0 and edge = 3").first()
    order = sorted(range(9))[:5]
    assert list(seen["down"]) == down[3][order].tolist() and list(seen["up"]) == up[3][order].tolist()


def every_move(parents):
    for cut in range(1, len(parents)):
        for below, above in itertools.product(*fitch.cut_sides(parents, cut)):
            yield cut, below, above, fitch.reconnected(parents, cut, below, above)


def test_gains_of_all_reconnections_equal_full_rescoring(spark, patterns):
    some = {("five", i): t for i, t in enumerate(every_tree(5)[::4])} | {("five", 90): [-1, 0], ("five", 91): every_tree(3)[0], ("quick", 1): every_tree(7)[500]}
    table = spark.createDataFrame([(a, i, t) for (a, i), t in some.items()], "aln_id string, tree_id long, parents array<int>")
    for size in (4096, 2):
        got = {(r["aln_id"], r["tree_id"], r["cut"], r["below"], r["above"]): r["gain"] for r in trees.reconnections(table, patterns, size).collect()}
        expected = {}
        for (a, i), t in some.items():
            masks, weights = matrix(patterns, a)
            old = fitch.length(t, masks[: newick.taxa(t)], weights)
            for cut, below, above, new in every_move(t):
                assert newick.problems(new) is None
                expected[a, i, cut, below, above] = old - fitch.length(new, masks[: newick.taxa(t)], weights)
        assert got == expected


def test_bisections_are_the_best_of_each_cut(spark, patterns):
    tree = every_tree(5)[3]
    masks, weights = matrix(patterns, "five")
    begin = spark.createDataFrame([("five", 0, tree, fitch.length(tree, masks, weights))], "aln_id string, tree_id long, parents array<int>, length long")
    for r in trees.bisections(begin, patterns).collect():
        least = min(fitch.length(t, masks, weights) for c, _, _, t in every_move(tree) if c == r["cut"])
        assert r["length"] == least == fitch.length(r["parents"], masks, weights)


def test_swapping_reaches_a_tree_without_better_neighbours(spark, patterns):
    begin = trees.greedy_trees(patterns).withColumn("tree_id", F.lit(0).cast("long"))
    end = {r["aln_id"]: (r["parents"], r["length"]) for r in trees.improved_trees(begin, patterns).collect()}
    for name in ("quick", "five"):
        masks, weights = matrix(patterns, name)
        parents, size = end[name]
        assert fitch.length(parents, masks, weights) == size
        assert all(fitch.length(t, masks, weights) >= size for _, _, _, t in every_move(parents))
    assert end["quick"][1] == 6


def test_node_tables_and_text(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(every_tree(5))] + [(99, [-1, 3, 3, 0, 3, 1])], "tree_id long, parents array<int>")
    nodes = trees.node_table(table)
    faults = trees.structure_faults(nodes, ["tree_id"])
    assert {r["tree_id"] for r in faults.collect()} == {99}
    good = table.filter("tree_id < 99").withColumn("newick", trees.newick_text(F.col("parents"))).withColumn("labels", F.array(*[F.lit(str(i + 1)) for i in range(5)]))
    back = trees.parsed_trees(good.withColumnRenamed("parents", "old"))
    assert back.filter("old = parents and error is null").count() == 15
    bad = trees.parsed_trees(good.limit(1).drop("parents").withColumn("newick", F.lit("((1,2),3)")))
    assert bad.first()["error"] and bad.first()["parents"] is None


def test_neighbour_joining_finds_an_additive_tree(spark):
    # a quartet with long inner edge: 1,2 | 3,4
    rows = [("q", 0, 1, 2), ("q", 0, 2, 8), ("q", 0, 3, 8), ("q", 1, 2, 8), ("q", 1, 3, 8), ("q", 2, 3, 2)]
    found = spark.createDataFrame(rows, "aln_id string, i long, j long, dist long")
    for adjusted in (True, False):
        text = trees.joined_neighbours(found, adjusted).first()["newick"]
        tree = newick.from_newick(text, {str(i + 1): i for i in range(4)})
        assert newick.to_newick(tree) == "(1,2,(3,4))"

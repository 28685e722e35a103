import itertools
import random

import numpy as np
import pytest

from cladeflow.functions import fitch, newick

# Two pairs of sites that no tree explains at once, each with weight 2: seven taxa, four sites.
QUICK = ["AAAA", "AAAA", "AAAA", "CCCC", "AAAA", "AACC", "CCAA"]
MASKS = np.array([[{"A": 1, "C": 2, "G": 4, "T": 8}[c] for c in row] for row in QUICK], np.uint8)
ONES = np.ones(4, np.int64)


def every_tree(n):
    trees = [newick.start()]
    for _ in range(2, n):
        trees = [newick.insert(t, e) for t in trees for e in range(1, len(t))]
    return trees


def brute_length(parents, masks, weights):
    """Least number of changes over all single bases at all nodes, site by site."""
    inner = [v for v in range(len(parents)) if newick.taxon_of(v) is None]
    total = 0
    for s in range(masks.shape[1]):
        best = 99
        leaves = [[b for b in (1, 2, 4, 8) if masks[t][s] & b] for t in range(len(masks))]
        for states in itertools.product(*leaves, *[(1, 2, 4, 8)] * len(inner)):
            at = {newick.node_of(t): x for t, x in enumerate(states[: len(masks)])} | dict(zip(inner, states[len(masks) :]))
            best = min(best, sum(at[v] != at[p] for v, p in enumerate(parents) if p >= 0))
        total += best * int(weights[s])
    return total


def test_known_tree_counts_and_lengths():
    sizes = [fitch.length(t, MASKS, ONES) for t in every_tree(7)]
    assert len(sizes) == 945 and min(sizes) == 6 and sizes.count(6) == 210 and max(sizes) == 8


def test_length_equals_brute_force():
    draw = np.random.default_rng(1)
    masks, weights = draw.integers(1, 16, (5, 4)).astype(np.uint8), np.array([1, 2, 3, 1])
    for t in every_tree(5)[::2]:
        assert fitch.length(t, masks, weights) == brute_length(t, masks, weights)


def test_insertion_costs_add_up():
    draw = np.random.default_rng(2)
    masks, weights = draw.integers(1, 16, (7, 30)).astype(np.uint8), draw.integers(1, 5, 30)
    for t in every_tree(5)[::3]:
        down, above, size = fitch.views(t, masks[:5], weights)
        costs = fitch.insertion_costs(down, above, masks[5], weights)
        for e in range(1, len(t)):
            assert fitch.length(newick.insert(t, e), masks[:6], weights) == size + costs[e]


def test_newick_and_back():
    for n in (2, 3, 6):
        names = {str(i + 1): i for i in range(n)}
        trees = every_tree(n)
        texts = [newick.to_newick(t) for t in trees]
        assert len(set(texts)) == len(trees)
        for tree, text in zip(trees, texts):
            back = newick.from_newick(text + ";", names)
            assert newick.to_newick(back) == text and newick.problems(back) is None
            assert back == tree


def test_newick_takes_lengths_names_and_polytomies():
    names = {"a": 0, "b b": 1, "c": 2, "d": 3, "e": 4}
    tree = newick.from_newick("((a:0.1,'b b':2)x:3,c,d,e);", names)
    assert newick.problems(tree) is None and newick.taxa(tree) == 5
    for bad in ("((a,'b b'),c,d", "(a,'b b',c,d,f);", "(a,a,'b b',c,d);", "", "a)"):
        with pytest.raises(ValueError):
            newick.from_newick(bad, names)


def test_problems_are_told():
    assert newick.problems([-1, 0]) is None
    assert newick.problems([-1, 3, 3, 0]) is None
    assert newick.problems([-1, 3, 0, 0]) and newick.problems([-1, 2]) and newick.problems([-1, 3, 3]) and newick.problems([])


def test_bisection_reaches_neighbours_and_never_loses_a_taxon():
    draw = random.Random(3)
    tree = every_tree(6)[draw.randrange(105)]
    seen = set()
    for cut in range(1, len(tree)):
        for below, above in itertools.product(*fitch.cut_sides(tree, cut)):
            out = fitch.reconnected(tree, cut, below, above)
            assert newick.problems(out) is None and newick.taxa(out) == 6
            seen.add(newick.to_newick(out))
    assert newick.to_newick(tree) in seen and 20 < len(seen) < 105


def test_greedy_and_cheapest_next_are_trees_no_shorter_than_best():
    for parents, size in (fitch.greedy(MASKS, ONES), fitch.cheapest_next(MASKS, ONES)[1:]):
        assert newick.problems(parents) is None and size >= 6

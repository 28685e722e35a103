import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions import bounds as b
from cladeflow.functions import fitch, newick
from cladeflow.operators import bounds, pairs, prefixes, sites, trees
from tests.test_trees_numpy import every_tree

SEED = 5


@pytest.fixture(scope="module")
def alignments():
    draw = np.random.default_rng(SEED)
    out = {"clear": 1 << draw.integers(0, 3, (6, 10)), "mixed": np.where(draw.random((6, 9)) < 0.15, 15, 1 << draw.integers(0, 4, (6, 9))), "twos": 1 << draw.integers(0, 2, (5, 8))}
    return {k: v.astype(np.uint8) for k, v in out.items()}


@pytest.fixture(scope="module")
def cells(spark, alignments):
    rows = [(k, s, t, int(m[t, s])) for k, m in alignments.items() for t in range(len(m)) for s in range(m.shape[1])]
    return spark.createDataFrame(rows, "aln_id string, site long, taxon long, mask int")


@pytest.fixture(scope="module")
def patterns(cells):
    return sites.patterns(sites.columns(cells)).persist()


def rests(masks):
    """Least that the taxa after rank k add, over all trees, for every k."""
    ones = np.ones(masks.shape[1], np.int64)
    full = {k: [] for k in range(2, len(masks))}
    for tree in every_tree(len(masks)):
        total = fitch.length(tree, masks, ones)
        for k in full:  # the tree of the first k + 1 taxa within this one
            near = {v: {w for w, p in enumerate(tree) if p == v} | ({tree[v]} if v else set()) for v in range(len(tree))}
            named = {v: newick.taxon_of(v) if newick.taxon_of(v) is not None else ("inner", v) for v in near}
            full[k].append(total - fitch.length(_first(near, named, k + 1), masks[: k + 1], ones))
    return {k: min(v) for k, v in full.items()}


def _first(near, named, n):
    near = {named[v]: {named[w] for w in ws} for v, ws in near.items()}
    for t in [x for x in near if isinstance(x, int) and x >= n]:
        (inner,) = near.pop(t)
        near[inner].discard(t)
        a, c = near.pop(inner)
        near[a].discard(inner)
        near[c].discard(inner)
        near[a].add(c)
        near[c].add(a)
    return newick._grown(near, n)


def test_no_rest_bound_exceeds_the_truth(cells, patterns, alignments):
    weights = patterns.select("aln_id", "site", "weight")
    kept = cells.join(weights.select("aln_id", "site"), ["aln_id", "site"], "left_semi")
    distinct = prefixes.rest_bound(kept, weights)
    incompatible = bounds.incompatibility_bounds(cells, patterns)
    tables = {
        "distinct": distinct, "spanning": bounds.spanning_rest_bounds(patterns), "partition": bounds.partition_bounds(patterns),
        "uninformative": bounds.uninformative_bounds(patterns), "corrected": bounds.corrected_bounds(patterns), "hitting": bounds.hitting_set_bounds(patterns),
    }
    tables["combined"] = bounds.combined(distinct, None, None, list(tables.values())[1:])
    truth = {(a, k): v for a, m in alignments.items() for k, v in rests(m).items()}
    for name, table in tables.items():
        got = {(r["aln_id"], r["k"]): r["bound"] for r in table.collect()}
        assert got and all(v <= truth[key] for key, v in got.items() if key in truth), name
    best = {(r["aln_id"], r["k"]): r["bound"] for r in tables["combined"].collect()}
    assert all(best[key] >= r["bound"] for r in distinct.collect() if (key := (r["aln_id"], r["k"])) in best)
    assert incompatible.filter("bound > 0").count() > 0


def test_whole_bounds_hold(patterns, alignments):
    least = {a: min(fitch.length(t, m, np.ones(m.shape[1], np.int64)) for t in every_tree(len(m))) for a, m in alignments.items()}
    lower = {r["aln_id"]: r["lower"] for r in bounds.whole_lower_bounds(patterns).collect()}
    parted = {r["aln_id"]: r["lower"] for r in bounds.partitioned_lower_bounds(patterns).collect()}
    assert all(0 < parted[a] <= least[a] for a in alignments)
    upper = {r["aln_id"]: r["upper"] for r in bounds.upper_bounds(patterns).collect()}
    swapped = {r["aln_id"]: r["upper"] for r in bounds.swapped_upper_bounds(patterns).collect()}
    for a in alignments:
        assert 0 < lower[a] <= least[a] <= swapped[a] <= upper[a]


def test_pruned_search_with_bounds_finds_all(spark, cells, patterns):
    weights = patterns.select("aln_id", "site", "weight")
    rest = prefixes.rest_bound(cells.join(weights.select("aln_id", "site"), ["aln_id", "site"], "left_semi"), weights)
    told = lambda x: {(r["aln_id"], tuple(r["parents"])) for r in x.collect()}
    found, counters = trees.search(patterns, bounds.swapped_upper_bounds(patterns), rest)
    every, more = trees.search(patterns)
    assert told(trees.shortest(found)) == told(trees.shortest(every))
    assert counters.agg(F.sum("kept")).first()[0] < more.agg(F.sum("kept")).first()[0]


def test_pair_costs(spark):
    table = {r["mask16"]: (r["cost"], r["extra"]) for r in bounds.pair_cost_table(spark).filter("mask16 % 97 = 5").collect()}
    assert bounds.pair_cost_table(spark).count() == 65535
    for mask, (cost, extra) in table.items():
        rows = [(k // 4, k % 4) for k in range(16) if mask >> k & 1]
        states = np.array([[1 << c, 1 << d] for c, d in rows], np.uint8)
        assert b.spanning_tree(b.distances(states, np.ones(2, np.int64))) == cost
        assert b.eliminated(states[:, 0], states[:, 1]) == (extra > 0)
        assert b.joint_mask(states[:, 0], states[:, 1]) == mask


def test_incompatible_pairs_both_ways(cells, patterns, alignments):
    clear = {(r["aln_id"], r["p"], r["q"]) for r in bounds.incompatible_pairs(cells).collect()}
    told = {(r["aln_id"], r["p"], r["q"]): r["incompatible"] for r in pairs.blocked_incompatible(cells, 3).collect()}
    for a, m in alignments.items():
        for p, q in itertools.combinations(range(m.shape[1]), 2):
            assert told.pop((a, p, q)) == b.eliminated(m[:, p], m[:, q])
    assert not told
    every = pairs.blocked_incompatible(cells).filter("incompatible").collect()
    assert clear <= {(r["aln_id"], r["p"], r["q"]) for r in every} and clear
    assert {k for k in clear if k[0] == "clear"} == {(r["aln_id"], r["p"], r["q"]) for r in every if r["aln_id"] == "clear"}


def test_parts(patterns, alignments):
    part = F.floor(F.col("site") / 3)
    for r in bounds.part_bounds(patterns, part, 3).collect():
        assert r["final"] == max(r["additive"], r["lower"] - r["upper"]) and r["width"] <= 3
    for r in bounds.two_way_scores(patterns, part).collect():
        assert r["best"] >= r["score"] >= 0
    masks = alignments["clear"]
    ones = np.ones(3, np.int64)
    for at in range(0, 9, 3):
        least = min(fitch.length(t, masks[:, at : at + 3], ones) for t in every_tree(6))
        assert b.part_lower(masks[:, at : at + 3]) <= least and b.best_two_way(masks[:, at : at + 3]) <= least


def test_part_lower_bounds_hold_for_all_trees_and_are_often_exact():
    draw = np.random.default_rng(21)
    every, exact, better = {n: every_tree(n) for n in (4, 5, 6)}, 0, 0
    for turn in range(120):
        n, width = int(draw.integers(4, 7)), int(draw.integers(1, 7))
        masks = (1 << draw.integers(0, 2 + turn % 3, (n, width))).astype(np.uint8)
        if turn % 4 == 0:
            masks = np.where(draw.random(masks.shape) < 0.25, draw.integers(1, 16, masks.shape), masks).astype(np.uint8)
        least = min(fitch.length(t, masks, np.ones(width, np.int64)) for t in every[n])
        low = b.part_lower(masks)
        rows = np.unique(masks, axis=0)
        tree = b.spanning_tree(b.distances(rows, np.ones(width, np.int64)))
        plain = max(-(-tree // 2), len(rows) - 1 if ((masks & (masks - 1)) == 0).all() else 0)
        assert plain <= low <= least
        exact, better = exact + (low == least), better + (low > plain)
    assert exact > 70 and better > 15


def test_group_bounds_of_known_rows():
    far = np.array([[0, 6, 6], [6, 0, 6], [6, 6, 0]])
    assert b.group_lower(far) == 9  # an inner point is nearer than two of the ways
    chain = np.array([[0, 3, 9], [3, 0, 6], [9, 6, 0]])
    assert b.group_lower(chain) == 9
    assert b.group_lower(np.array([[0, 0, 4], [0, 0, 5], [4, 5, 0]])) == 4  # the first two may be one row


def test_partitions_by_moves_use_each_site_once_and_beat_a_first_fit():
    draw = np.random.default_rng(22)
    better = 0
    for turn in range(12):
        n, width = int(draw.integers(5, 9)), int(draw.integers(4, 14))
        masks = (1 << draw.integers(0, 2 + turn % 3, (n, width))).astype(np.uint8)
        for first in (None, 3, n - 1):
            parts, total = b.optimised_partition(masks, first)
            score = (lambda p: b.part_lower(masks[:, p])) if first is None else (lambda p: b.part_final(masks[:, p], first))  # noqa: B023
            assert sorted(sum(parts, [])) == list(range(width)) and total == sum(map(score, parts))
            fit: list = []
            for site in range(width):
                gains = [(score([*p, site]) - score(p) - score([site]), -k) for k, p in enumerate(fit) if len(p) < 4]
                if gains and max(gains)[0] > 0:
                    fit[-max(gains)[1]] += [site]
                else:
                    fit.append([site])
            assert total >= sum(map(score, fit))
            better += total > sum(map(score, fit))
    assert better


def test_more_tries_give_no_less(patterns):
    few, many = ({(r["aln_id"], r["k"]): r["bound"] for r in bounds.corrected_bounds(patterns, n).collect()} for n in (1, 12))
    assert few.keys() == many.keys() and all(many[k] >= few[k] for k in few) and sum(many.values()) > sum(few.values())


def test_layers_of_weights_count_as_often_as_they_stand_there(spark):
    draw = np.random.default_rng(23)
    rows = [("w", i, [int(1 << x) for x in draw.integers(0, 3, 6)], int(draw.integers(1, 4))) for i in range(8)]
    rows += [("same", i, [1, 1, 1, 2, 4, 8], 5) for i in range(3)] + [("three", 0, [1, 2, 4], 1)]
    table = spark.createDataFrame(rows, "aln_id string, site long, states array<int>, weight long")
    got = {(r["aln_id"], r["k"]): r["bound"] for r in bounds.partition_bounds(table).collect()}
    assert {k for a, k in got if a == "w"} == {2, 3, 4} and not any(a == "three" for a, _ in got)
    assert got["same", 2] == 45 and got["same", 3] == 30
    masks, weights = np.array([r[2] for r in rows if r[0] == "w"], np.uint8).T, np.array([r[3] for r in rows if r[0] == "w"])
    for first in (3, 4, 5):
        expected = sum(b.optimised_partition(masks[:, weights >= level], first)[1] for level in range(1, weights.max() + 1))
        assert got["w", first - 1] == expected


def test_surplus_bound_holds(cells, alignments):
    got = {r["aln_id"]: r["bound"] for r in bounds.surplus_bounds(cells).collect()}
    for a in ("clear", "twos"):
        m = alignments[a]
        assert got[a] <= min(fitch.length(t, m, np.ones(m.shape[1], np.int64)) for t in every_tree(len(m)))


def test_orders(cells, patterns):
    dist = pairs.fitch_distances(cells)
    for table in [bounds.addition_orders(dist, r) for r in ("max_min", "max_sum")] + [bounds.placement_orders(patterns, r) for r in bounds.RULES]:
        for name, n in (("clear", 6), ("twos", 5)):
            rows = table.filter(F.col("aln_id") == name).orderBy("rank").collect()
            assert [r["rank"] for r in rows] == list(range(n)) and sorted(r["taxon"] for r in rows) == list(range(n))


def test_known_order():
    # seven taxa: 1-3 and 5 equal, then CCCC, AACC and CCAA; each site with the weight of its pattern
    masks = np.array([[1, 1], [1, 1], [1, 1], [2, 2], [1, 1], [1, 2], [2, 1]], np.uint8)
    order = b.addition_order(b.distances(masks, np.array([2, 2])))
    assert [t + 1 for t in order] == [1, 4, 6, 7, 5, 3, 2]


def test_rest_upper_bounds_are_no_less_than_the_rest(cells, patterns, alignments):
    got = {(r["aln_id"], r["k"]): r["bound"] for r in bounds.rest_upper_bounds(patterns, pairs.fitch_distances(cells)).collect()}
    for a, m in alignments.items():
        # hanging the later taxa's tree on the earlier ones': what the best whole tree adds is no more, where states are single
        ones = np.ones(m.shape[1], np.int64)
        whole = min(fitch.length(t, m, ones) for t in every_tree(len(m)))
        for k in range(1, len(m) - 1):
            head = min(fitch.length(t, m[: k + 1], ones) for t in every_tree(k + 1))
            assert a == "mixed" or got[a, k] >= whole - head


def test_matching_uses_each_copy_once():
    found = [(0, 1, 9, 1), (1, 2, 9, 1), (2, 3, 9, 2)]
    assert b.matching(found, {0: 1, 1: 1, 2: 1, 3: 1}) == (2, 3)
    assert b.matching(found, {0: 2, 1: 3, 2: 1, 3: 1}) == (3, 4)


def test_spanning_tree_equals_brute_force():
    draw = np.random.default_rng(8)
    m = draw.integers(1, 9, (5, 5))
    m = np.triu(m, 1) + np.triu(m, 1).T
    edges = list(itertools.combinations(range(5), 2))
    best = 99
    for chosen in itertools.combinations(edges, 4):
        root = list(range(5))
        for i, j in chosen:
            root = [root[i] if r == root[j] else r for r in root]
        if len(set(root)) == 1:
            best = min(best, sum(int(m[e]) for e in chosen))
    assert b.spanning_tree(m) == best


def test_tries_side_by_side_equal_one_after_another():
    draw = np.random.default_rng(61)
    for n, sites, most in ((6, 16, 1), (5, 9, 3), (4, 6, 1), (7, 3, 1), (6, 1, 1)):
        for high in (None, 16):
            cells = [((1 << draw.integers(0, 4, (n, sites)) if high is None else draw.integers(1, high, (n, sites))).astype(np.uint8), draw.integers(1, most + 1, sites)) for _ in range(9)]
            firsts, seeds = [3 + k % max(1, n - 3) for k in range(9)], draw.integers(0, 1 << 32, 9).tolist()
            assert b.corrected_tries(cells, firsts, seeds) == [b.corrected_try(*c, f, s) for c, f, s in zip(cells, firsts, seeds)]


def test_covers_equal_a_search_site_by_site():
    draw = np.random.default_rng(62)
    for _ in range(5):
        masks = (1 << draw.integers(0, 4, (6, 14))).astype(np.uint8)
        i, j = np.triu_indices(6, 1)
        apart, free = (masks[i] & masks[j]) == 0, set(range(14))
        for _, cover in b.hitting_sets(masks, 3):
            open_ = np.ones(15, bool)
            for s in cover:
                assert s == min(free, key=lambda x: (-int(apart[open_, x].sum()), b.part_upper(masks[:, [x]], 3), x))
                free.discard(s)
                open_ &= ~apart[:, s]
        assert not any(apart[:, s].any() for s in free)


def test_only_unused_pairs_of_sites_are_looked_at(monkeypatch):
    draw, seen, whole = np.random.default_rng(63), [], b.part_lower
    masks, weights = (1 << draw.integers(0, 4, (9, 30))).astype(np.uint8), draw.integers(1, 4, 30)
    total, used = sum(int(w) * whole(masks[:, [s]]) for s, w in enumerate(weights)), set()
    for s in range(30):
        for t in range(s + 1, 30):
            gain = whole(masks[:, [s, t]]) - whole(masks[:, [s]]) - whole(masks[:, [t]])
            if gain > 0 and not used & {s, t}:
                used |= {s, t}
                total += int(min(weights[s], weights[t])) * gain
    monkeypatch.setattr(b, "part_lower", lambda some: seen.append(1) or whole(some))
    assert b.paired_lower(masks, weights) == total and len(seen) < 30 * 29 // 4


def test_orders_from_rows_equal_those_from_a_matrix(spark):
    draw, rows, expected = np.random.default_rng(64), [], {}
    for n, sites, high in ((2, 3, 16), (3, 2, 4), (14, 5, 16), (30, 9, 3), (25, 70, 16), (9, 1, 2)):
        masks = draw.integers(1, high, (n, sites))
        rows += [(f"n{n}", s, t, int(masks[t, s])) for t in range(n) for s in range(sites)]
        expected[f"n{n}"] = b.distances(masks, np.ones(sites, np.int64))
    cells = spark.createDataFrame([*rows, ("one", 0, 0, 1)], "aln_id string, site long, taxon long, mask int").repartition(3)
    for rule in ("max_min", "max_sum"):
        got = {}
        for r in bounds.addition_orders_of_cells(cells, rule).orderBy("rank").collect():
            got.setdefault(r["aln_id"], []).append(r["taxon"])
        assert got == {name: b.addition_order(m, rule) for name, m in expected.items()}


def test_uninformative_parts_at_once_equal_one_by_one():
    draw = np.random.default_rng(65)
    for n, sites, most in ((6, 17, 1), (5, 8, 4), (4, 1, 2), (6, 3, 3), (7, 30, 1)):
        masks, weights = (1 << draw.integers(0, 4, (n, sites))).astype(np.uint8), draw.integers(1, most + 1, sites)
        pairs = ((masks[:, None] & masks[None]) == 0)[np.triu_indices(n, 1)].astype(np.int8)
        assert b.simple_partitions(pairs, n).tolist() == [b.simple_partition(masks[:, [s]]) for s in range(sites)]
        forced, best = b.forced_weights(masks[:3]), b.spanning_tree(b.distances(masks, weights)) // 2
        for turn in range(6):
            total = 0
            for part in b.random_parts(sites, 9 + turn):
                times = int(weights[part].min())
                total += times * b.best_two_way(masks[:, part]) + sum((int(weights[s]) - times) * b.simple_partition(masks[:, [s]]) for s in part)
            best = max(best, total)
        assert b.uninformative_bound(masks, weights, forced, 9) == max(0, best - int((forced * weights).sum()))

import random
import re
from collections import Counter

import numpy as np
import pytest

from cladeflow.llm import collisions, jaccard_join
from cladeflow.llm.components import connected_components
from cladeflow.llm.jaccard_join import needed_matches, shared_counts, similar_documents
from cladeflow.llm.shared_files import Tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), doc) if x is not None), default=None)
    return Counter((doc, least[top(i)], links[i]) for i, (doc, _) in enumerate(rows))


def corpus(seed, families=6, size=9, edits=4, length=60):
    draw = random.Random(seed)
    word = lambda: "w%d" % draw.randint(0, 900)
    rows = []
    for _ in range(families):
        base = [word() for _ in range(draw.randint(5, length))]
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randint(0, edits)):
                copy[draw.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += ["", None, "...", "a b", "A, b!", "a b c", "x " * 3000, "x " * 4000]
    draw.shuffle(rows)
    return list(enumerate(rows)) + [(3, rows[3]), (3, rows[3])]


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, b"z") for i, t in rows], "doc_id long, text string, key binary")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in similar_documents(frame).collect())
    assert got == brute(rows)


def test_equals_brute_force(spark):
    check(spark, corpus(1))


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 4)
    monkeypatch.setattr(collisions, "PAIRS", 16)
    check(spark, corpus(2, families=4, size=16, edits=3, length=80))


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_counts_both_ways(monkeypatch):
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 60, 40).astype(np.uint64)) for _ in range(6)]
    a, b = (x.ravel() for x in np.indices((6, 6)))
    expected = [len(set(sets[i]) & set(sets[j])) for i, j in zip(a, b)]
    held = jaccard_join.Sets([x.tobytes() for x in sets])
    for cost in (0, 10**9):
        monkeypatch.setattr(jaccard_join, "GATHER_COST", cost)
        monkeypatch.setattr(jaccard_join, "GATHERED", 50)
        assert shared_counts(held, a, b).tolist() == expected
        assert shared_counts(held, a[:3], b[:3]).tolist() == expected[:3]


def test_pruning_bounds_rise():
    needed = needed_matches(0.8, 1e-7)
    assert needed[0] == 0 and all(x <= y <= x + 1 for x, y in zip(needed, needed[1:])) and 50 < needed[128] < 102


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (7, 7), (300, 300)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {i: 100 for i in range(101, 130)} | {201: 200, 202: 200}


def test_buckets_over_several_tasks(spark, monkeypatch):
    """Members of one bucket that lie in many tasks, or are too many to be held, are still tied."""
    monkeypatch.setattr(collisions, "CHUNK", 16)
    monkeypatch.setattr(collisions, "BLOCK", 32)
    base = ["w%d" % i for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[i % 60] = "e%d" % i
        rows.append((i, " ".join(copy)))
    check(spark, [*rows, (None, rows[3][1]), (None, None)])


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_equal_a_union_of_sets(spark, kind):
    draw = random.Random(12)
    order = draw.sample(range(200), 200)
    edges = [*zip(order, order[1:]), *((500, x) for x in range(600, 900)), (500, 7), *((draw.randrange(1000, 1300), draw.randrange(1000, 1300)) for _ in range(250))]
    root = {i: i for e in edges for i in e}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    name = (lambda i: i) if kind == "long" else (lambda i: i.to_bytes(2, "big"))
    frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}")
    got = {r["id"]: r["root"] for r in connected_components(frame, Tables(spark)).collect()}
    assert got == {name(i): name(top(i)) for i in root if top(i) != i}

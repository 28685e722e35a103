import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.llm import mixing
from cladeflow.llm.mixing import mix_sources, mixed_slots, numbered, permuted
from cladeflow.llm.shared_files import Tables


def words(text):
    return len(re.findall("[^\\x20\\x09-\\x0D]+", text or ""))


def goals(rows):
    """Targets by repeated resharing."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += words(text)
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, out = set(), {}
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        rest = sum(weight[s] for s in names if s not in capped)
        out = {s: Fraction(3 * size[s]) if s in capped else Fraction(left * weight[s], rest) for s in names}
        over = {s for s in names if s not in capped and out[s] > 3 * size[s]}
        if not over:
            return size, out
        capped |= over


def make(seed, n=300):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = "big" if draw.random() < 0.4 else [None, "", "a", "B", "é", "\U0001f600", "small"][int(draw.integers(0, 7))]
        if source == "small" and draw.random() < 0.9:
            source = "a"
        rows.append((i, " ".join(["wo rd"] * int(draw.integers(0, 90))) + "\t\x0b", source))
    return rows + [(5, rows[5][1], rows[5][2])] * 3 + [(None, "a b", "a"), (400, None, "a"), (401, "", "none"), (402, None, "none"), (403, "\x1c \x00", "big"), (404, "w " * 30_000, "big")]


def check(spark, rows, block, shard):
    frame = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, source string, size int, target string").repartition(3)
    got = mix_sources(frame, block, shard).collect()
    again = mix_sources(frame.repartition(5), block, shard).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    size, goal = goals(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    taken = defaultdict(int)
    source = {(i, words(t)): s for i, t, s in rows}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(float(goal[s])) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= Fraction(1, 2) + Fraction(1, 10**6) for s in size)
    return frame, got


def test_targets_are_met_and_reruns_agree(spark):
    for seed, block, shard in ((1, 512, 4096), (2, 16, 50), (3, 1, 7)):
        check(spark, make(seed), block, shard)


def test_equals_words_taken_one_by_one(spark):
    rows = make(4, 150)
    block, shard = 8, 40
    frame, got = check(spark, rows, block, shard)
    tables = Tables(spark)
    sources, placed = numbered(frame, tables)
    sources = sources.persist()
    slots = mixed_slots(mixing._plan(sources.select("rank", "source_size", "target"), block, 0), block, shard).collect()
    # every shard's slots are 0 .. n - 1, and a block comes back only when all others have come
    for s in {r["shard"] for r in slots}:
        held = sorted(r["slot"] for r in slots if r["shard"] == s)
        assert held == list(range(len(held)))
    times = Counter((r["rank"], r["block"]) for r in slots)
    for rank in {k for k, _ in times}:
        seen = [n for (k, _), n in times.items() if k == rank]
        every = -(-sources.filter(F.col("rank") == rank).first()["source_size"] // block)
        assert max(seen) <= 3 and max(seen) - (min(seen) if len(seen) == every else 0) <= 1
    # the words of each source in their order, counted where slots take them
    owner = defaultdict(dict)
    docs = placed.collect()
    for k, r in enumerate(docs):
        for w in range(r["start"], r["start"] + r["size"]):
            assert w not in owner[r["rank"]]
            owner[r["rank"]][w] = k
    taken = Counter()
    for r in slots:
        for w in range(r["block"] * block, r["block"] * block + r["words"]):
            taken[owner[r["rank"]][w]] += 1
    expected = Counter((r["doc_id"], r["size"], taken[k]) for k, r in enumerate(docs))
    assert expected == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)
    tables.drop_all()


def test_shards_get_near_equal_shares(spark):
    plan = spark.createDataFrame([(0, 60_000, 60_000, 60_000, 1), (1, 20_000, 20_000, 20_000, 1)], "rank long, source_size long, blocks long, slots long, last long")
    rows = mixed_slots(plan, 1, 1000).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 0).alias("a")).collect()
    assert len(rows) == 80 and all(abs(r["n"] - 1000) < 160 and abs(r["a"] / r["n"] - 0.75) < 0.07 for r in rows) and len({r["a"] for r in rows}) > 10


def test_draws_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    check(spark, make(6, 100), 4, 9)


def test_permutations():
    for n in (1, 2, 5, 64, 1000):
        i = np.arange(n)
        out = permuted(i, n, 12345)
        assert sorted(out.tolist()) == i.tolist() and (permuted(out, n, 12345, inverse=True) == i).all()
        assert n < 64 or (out != permuted(i, n, 12346)).any()


def test_empty_table(spark):
    out = mix_sources(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert out.count() == 0 and out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {tuple(r) for r in mix_sources(none).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}

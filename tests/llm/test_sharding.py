import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st

from cladeflow.llm import sharding
from cladeflow.llm.sharding import find_cuts, greedy, level_cuts, shard_by_bytes, smallest_capacity


def best(sizes, shards):
    """Least capacity by trying all of them."""
    capacity = max([*sizes, -(-sum(sizes) // shards)])
    while True:
        need, held = 1, 0
        for s in sizes:
            if held + s > capacity:
                need, held = need + 1, 0
            held += s
        if need <= shards:
            return capacity
        capacity += 1


@given(st.lists(st.integers(1, 40), min_size=1, max_size=30), st.integers(1, 8))
def test_capacity_is_the_smallest(sizes, shards):
    capacity = smallest_capacity(sizes, shards)
    assert capacity == best(sizes, shards) and greedy(sizes, shards, capacity) is not None
    starts = level_cuts(sizes, shards, capacity)
    assert len(starts) == shards and starts == sorted(starts)
    assert max(sum(sizes[a:b]) for a, b in zip(starts, [*starts[1:], len(sizes)])) <= capacity


def corpus(seed, n=300):
    draw = random.Random(seed)
    rows = [(i, "é" * draw.randint(0, 50) + str(draw.randint(0, 10**6))) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, ""), (None, "n"), (5, rows[5][1]), (5, rows[5][1])]
    return rows


def test_cuts_are_exact_at_any_grain(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEVELS", (2, 4, 6, 8, 12, 20, 40, 64))
    draw = random.Random(4)
    for n, shards in ((200, 8), (40, 3), (6, 8)):
        rows = sorted({draw.randint(-(2**63), 2**63 - 1): draw.randint(1, 99) for _ in range(n)}.items())
        cuts = find_cuts(spark.createDataFrame(rows, "key long, bytes long"), shards)
        sums = Counter()
        for key, size in rows:
            sums[sum(c is not None and key >= c for c in cuts)] += size
        assert max(sums.values()) == best([s for _, s in rows], shards)


def test_contract(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    found = shard_by_bytes(docs, ["doc_id"]).collect()
    assert Counter((r["row"]["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        of_text[r["size"], r["text_crc32"]].add(r["shard"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_empty_table_and_one_text(spark):
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0
    one = spark.createDataFrame([(i, "same") for i in range(30)], "doc_id long, text string")
    assert len({r["shard"] for r in shard_by_bytes(one, ["doc_id"]).collect()}) == 1

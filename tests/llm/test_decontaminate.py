import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeflow.llm.decontaminate import Phrases, contaminated, decontaminate, search_shard
from cladeflow.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [] if text is None else WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(text, items, width=13):
    doc, hit, names = words(text), set(), set()
    for item, other in items:
        w = words(other)
        k = min(width, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(doc)):
            if tuple(doc[i : i + k]) in windows and k:
                hit.update(range(i, i + k))
                names.add(str(item))
    return len(doc), len(hit), sorted(names), hit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=4), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_index_finds_every_occurrence(runs, phrase):
    text = np.array([s for r in runs for s in [*r, 0]])
    index = FMIndex(text, 3, sample=3)
    low, high = index.search(np.array(phrase), np.array([0]), len(phrase))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    m = len(phrase)
    assert found == [i for i in range(len(text)) if text[i : i + m].tolist() == phrase]


def make(seed):
    draw = random.Random(seed)
    vocabulary = ["a", "bé", "c1", "d", "e"]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(1, say(30)), (2, say(13)), (3, "zz yy"), (3, say(15)), (10, ""), (11, None), (None, "qq")]
    docs = [say(60) for _ in range(5)] + [None, "", "...", "zz YY, zz", "QQ"]
    docs += [say(20) + " x " + items[0][1][:60] + " " + say(9), items[1][1].upper(), items[1][1].upper(), items[0][1] + " " + items[0][1]]
    return docs, items


def test_shard_equals_brute_force():
    for seed in range(8):
        docs, items = make(seed)
        named = [("null" if i is None else str(i), t) for i, t in items]
        phrases = Phrases(named, 13)
        for text, (spans, names) in zip(docs, search_shard([phrases.symbols(t) for t in docs], phrases)):
            _, n, expected, hit = brute(text, named)
            assert sorted(set(names)) == expected
            assert {w for a, b in spans for w in range(a, b)} == hit and sum(b - a for a, b in spans) == n


def test_operator_in_blocks_with_clashing_columns(spark):
    docs, items = make(3)
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(None, docs[-1], None), (0, docs[0], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if i is None else str(i), t) for i, t in items]
    expected = sorted((i, *brute(t, named)[:3]) if i is not None else (-1, *brute(t, named)[:3]) for i, t, _ in rows)
    for block_words in (1 << 20, 20):
        found = decontaminate(frame, bench, ["doc_id", "n_words"], block_words=block_words, shard_words=50).collect()
        got = sorted((-1 if r["row"]["doc_id"] is None else r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found)
        assert got == expected


def test_rule_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 100 + "k l")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none, ["doc_id"]).first()["n_hit"] == 0
    one = spark.createDataFrame([(7, "k l")], "item_id long, text string")
    assert decontaminate(docs, one, ["doc_id"]).select(contaminated().alias("x"), "spans").first() == (False, [(100, 102)])
    assert decontaminate(docs.limit(0), one, ["doc_id"]).count() == 0


def test_long_items_and_texts_in_several_blocks(spark, monkeypatch):
    from cladeflow.llm import decontaminate as module

    monkeypatch.setattr(module, "PART", 40)
    draw = random.Random(9)
    say = lambda n: " ".join("t%d" % draw.randint(0, 5000) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((300, 52, 53, 40, 13, 12, 4))]
    long = items[0][1].split()
    docs = [say(30_000) + " " + " ".join(long[k : k + 14]) + " " + say(10) for k in range(0, 280, 9)] + [t for _, t in items]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_words=120).collect()
    windows = {}
    for name, t in items:
        w = t.split()
        for at in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[at : at + 13]), set()).add(str(name))
    widths = {len(w) for w in windows}
    for r in found:
        w, hit, names = docs[r["row"]["doc_id"]].split(), set(), set()
        for k in widths:
            for at in range(len(w) - k + 1):
                of = windows.get(tuple(w[at : at + k]))
                if of:
                    hit.update(range(at, at + k))
                    names |= of
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(names))


def test_a_block_of_unlike_words_is_small():
    import tracemalloc

    tracemalloc.start()
    Phrases([("i", " ".join("w%d" % k for k in range(200_000)))], 13)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()

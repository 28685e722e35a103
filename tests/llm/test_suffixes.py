import random
import re

import numpy as np
import pyarrow as pa

from cladeflow.llm import suffixes
from cladeflow.llm.suffixes import PASSAGE, PIECE, minimisers, repeated_passages, window_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    where = {}
    split = [(i, WORD.findall((t or "").lower())) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - PASSAGE + 1):
            where.setdefault(tuple(w[a : a + PASSAGE]), set()).add(i)
    out = {}
    for i, w in split:
        for a in range(len(w) - PASSAGE + 1):
            found = where[tuple(w[a : a + PASSAGE])]
            if len(found) > 1 and i is not None:
                r, d = out.setdefault(i, (set(), set()))
                r.update(range(a, a + PASSAGE))
                if min(found) < i:
                    d.update(range(a, a + PASSAGE))
    return out


def words_of(spans):
    return {w for s in spans for w in range(s["start"], s["end"])}


def corpus(seed):
    draw = random.Random(seed)
    say = lambda n: " ".join("w%d" % draw.randint(0, 400) for _ in range(n))
    shared = [say(n) for n in (49, 50, 51, 60, 90, 200)]
    rows = [(i, " ".join([say(draw.randint(0, 80)), draw.choice(shared), say(draw.randint(0, 80)), draw.choice(shared)])) for i in range(40)]
    edited = rows[0][1].split()
    edited[60] = "other"
    rows += [(50, " ".join(edited)), (51, rows[0][1]), (52, None), (53, ""), (54, say(20)), (55, "x " * 300), (56, "x " * 120), (57, say(6000) + " " + shared[4])]
    heavy = " ".join("é%d" % draw.randint(0, 400) + "long" * draw.choice((1, 30)) for _ in range(70))
    rows += [(60, say(40) + " " + heavy), (61, heavy + " " + say(40)), (62, "A--" + heavy.upper().replace("É", "é"))]
    return rows + [(3, rows[3][1]), (3, shared[5]), (3, say(3)), (None, rows[4][1])]


def test_equals_brute_force(spark):
    for seed, piece in ((1, PIECE), (2, PIECE), (1, 3), (2, 1)):
        rows = corpus(seed)
        frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
        got = {r["doc_id"]: r for r in repeated_passages(frame, piece).collect()}
        expected = brute([r for r in rows if r[0] is not None])
        assert set(got) == set(expected)
        for i, (repeated, removed) in expected.items():
            assert words_of(got[i]["repeated"]) == repeated and got[i]["n_repeated"] == len(repeated)
            assert words_of(got[i]["removed"]) == removed and got[i]["n_removed"] == len(removed)


def test_runs_do_not_depend_on_batches(monkeypatch):
    draw = random.Random(5)
    texts = [t for _, t in corpus(3) if t] * 2
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    parts = [pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": texts})]
    found = pa.Table.from_batches(suffixes._suffixes(iter(parts))).to_pylist()
    asked = [[{"position": r["position"], "pieces": 1} for r in found if r["doc_id"] == i] for i in ids]
    kind = pa.list_(pa.struct([("position", pa.int32()), ("pieces", pa.int32())]))
    parts = [pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": texts, "asked": pa.array(asked, kind)})]
    ordered = pa.Table.from_batches(suffixes._contexts(iter(parts))).sort_by([(c, "ascending") for c in ("suffix", "piece", "right")])
    told = []
    for step, size in ((1, 1), (7, 3), (100, 10), (10**6, 1000)):
        monkeypatch.setattr(suffixes, "STEP", step)
        rows = pa.Table.from_batches(suffixes._walk(iter(ordered.to_batches(max_chunksize=size)))).to_pylist()
        told.append(sorted((r["doc_id"], a, b) for r in rows for a, b in zip(r["starts"], r["later"])))
    assert told[0] and all(t == told[0] for t in told)


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_window_hashes_depend_on_their_words_alone():
    draw = np.random.default_rng(2)
    part = draw.integers(0, 2**63, 80).astype(np.uint64)
    long = np.concatenate([draw.integers(0, 2**63, 33).astype(np.uint64), part, part[:7]])
    for width in (1, 7, 8, 19, 50):
        assert (window_hashes(long, width)[33 : 33 + 80 - width + 1] == window_hashes(part, width)).all()
        assert len(set(window_hashes(long[:100], width).tolist())) == 100 - width + 1


def test_equal_stretches_keep_equal_minimisers():
    draw = np.random.default_rng(3)
    part = draw.integers(0, 2**63, 300).astype(np.uint64)
    long = np.concatenate([draw.integers(0, 2**63, 100).astype(np.uint64), part])
    inside = minimisers(long) - 100
    assert set(inside[inside >= 40]) <= set(minimisers(part)) and np.diff(minimisers(part)).max() <= 32

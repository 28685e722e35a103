import re
import zlib
from collections import Counter

import numpy as np

from cladeflow.llm.spelling import near_words, spelling_variants


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    near = {w: [x for x in words if within_one(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def told(found):
    rows = [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force(spark):
    draw = np.random.default_rng(11)
    letters = list("abé")
    base = ["".join(draw.choice(letters, 7 + int(draw.integers(0, 6)))) for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "Ünüsüal", "ünüsüal"]
    rows = []
    for i in range(400):
        some = []
        for w in draw.choice(base, 12):
            if draw.random() < 0.3:
                k = int(draw.integers(0, len(w)))
                w = [w[:k] + w[k + 1 :], w[:k] + str(draw.choice(letters)) + w[k:], w[:k] + "b" + w[k + 1 :]][int(draw.integers(0, 3))]
            some.append(w.upper() if w.isascii() and draw.random() < 0.1 else w)
        rows.append((i, " ".join(some)))
    rows += [(7, rows[7][1])] * 3 + [(None, rows[0][1]), (900, None), (901, ""), (902, "12 34"), (903, ("hugeword " * 40_000)), (904, "hugewortāhugewort hugewort"), (905, "x" * 50_000 + " " + "x" * 50_000)]
    frame = spark.createDataFrame([(*r, "clash", 1, "k") for r in rows], "doc_id long, text string, word string, n long, root string")
    got = told(spelling_variants(frame))
    assert got == brute(rows)
    assert any(r[1] is not None for r in got) and any(r[4] > 3 for r in got)


def test_chains_of_forms(spark):
    words = {"abcdefghij": 5000, "abcdefghix": 400, "abcdefghyx": 32, "abcdefgzyx": 2}
    rows = [(i, w) for w, n in words.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = told(spelling_variants(frame))
    assert got == brute(rows)
    assert len({r[2] for r in got if r[1] is not None and r[1] != r[2]}) == 1


def test_every_pair_once_wherever_the_edit_is(spark):
    for base in ("abcdefg", "abcdefghijklmno", "aaaaaaaa"):
        words = {base} | {base[:k] + c + base[k + 1 :] for k in range(len(base)) for c in "az"} | {base[:k] + c + base[k:] for k in range(len(base) + 1) for c in "az"}
        frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
        got = [tuple(sorted((r["x"], r["y"]))) for r in near_words(frame).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a < b and within_one(a, b)}


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0

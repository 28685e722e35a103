"""Near copies of paragraphs against brute force; no pair is lost, whatever its length."""

import random
import re
from collections import Counter

import pytest

from cladeflow.llm import paragraphs
from cladeflow.llm.paragraphs import Units, repeated_paragraphs
from cladeflow.llm.shared_files import Tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def units(text):
    """Lines, and sentences where a line has several, with their sets of shingles."""
    for m in re.finditer(r"[^\n]+", text):
        inner = [x.span() for x in re.finditer(r"(?:^|\S).*?(?:(?<=[.!?])(?=\s)|$)", m[0])]
        for a, b in {(0, len(m[0])), *(inner if len(inner) > 1 else ())}:
            w = WORD.findall(m[0][a:b].lower())
            if w:
                yield m.start() + a, m.start() + b, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    all_ = [(d, *u) for d, t in rows if t and d is not None for u in units(t)]
    root = list(range(len(all_)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(all_):
        for j in range(i):
            both = len(x[3] & all_[j][3])
            if both and 5 * both >= 4 * len(x[3] | all_[j][3]):
                root[top(i)] = top(j)
    docs = {}
    for i, u in enumerate(all_):
        docs.setdefault(top(i), set()).add(u[0])
    return Counter((*u[:3], min(docs[top(i)]), u[0] != min(docs[top(i)])) for i, u in enumerate(all_) if len(docs[top(i)]) > 1)


def corpus(seed):
    draw = random.Random(seed)
    say = lambda n: (" ".join("w%d" % draw.randint(0, 500) for _ in range(n)) + ".").capitalize()
    shared = [say(30), say(16), say(14) + " " + say(20) + " " + say(13), "Short line here.", say(90)]
    rows = []
    for i in range(40):
        line = say(draw.randint(1, 60))
        extra = draw.choice(shared)
        if draw.random() < 0.4:
            w = extra.split()
            w[draw.randrange(len(w))] = "new"
            extra = " ".join(w)
        rows.append((i, "\n".join([say(9), line + (" " if len(line.split()) > 30 else "\n") + extra, "", say(20)])))
    return rows + [(60, None), (61, ""), (62, "\n\n"), (63, rows[0][1]), (64, (say(15) + " ") * 2 + say(3)), (None, rows[0][1]), (65, "x " * 5000), (0, rows[0][1])]


def found(spark, rows):
    frame = spark.createDataFrame([(i, t, 2) for i, t in rows], "doc_id long, text string, key int")
    return Counter(tuple(r) for r in repeated_paragraphs(frame).collect())


def test_lines_of_any_length_equal_brute_force(spark):
    draw = random.Random(8)
    say = lambda n: (" ".join("v%d" % draw.randint(0, 9999) for _ in range(n)) + ".").capitalize()
    near = say(40)
    short = " ".join(say(9) for _ in range(8))
    # a long line of short sentences with a word changed
    rows = [*corpus(4), (80, near), (81, near + " more"), (82, short), (83, re.sub(r"\w+\.$", "end.", short)), (84, near + " more and"), (85, "\t" + short + "  ")]
    expected = brute(rows)
    assert {80, 81, 82, 83} <= {r[0] for r in expected}
    assert found(spark, rows) == expected


@pytest.mark.parametrize("crowd", [2, 512])
def test_crowded_buckets_and_several_blocks(spark, monkeypatch, crowd):
    from cladeflow.llm import collisions

    monkeypatch.setattr(paragraphs, "CROWD", crowd)
    monkeypatch.setattr(collisions, "BLOCK", 8)
    draw = random.Random(5)
    common = "this phrase is in every line"
    rows = []
    for i in range(60):
        own = ["u%d" % draw.randint(0, 40) for _ in range(14)]
        rows.append((i, " ".join([*own[:7], common, *own[7:]])))
    base = ["b%d" % i for i in range(30)]
    for i in range(60, 100):
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(30)] = "e%d" % draw.randint(0, 5)
        rows.append((i, " ".join(copy)))
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [8, 256])
def test_families_and_sizes_in_crowded_buckets(spark, monkeypatch, block):
    from cladeflow.llm import collisions

    monkeypatch.setattr(paragraphs, "CROWD", 2)
    monkeypatch.setattr(collisions, "BLOCK", block)
    draw = random.Random(6)
    common = ["c%d" % i for i in range(60)]
    rows = []
    for i in range(80):  # a boilerplate, some of it left out, with own words that some lines share
        own = ["o%d" % draw.randint(0, 60) for _ in range(draw.randint(0, 16))]
        rows.append((i, " ".join([*common[: 60 - draw.randint(0, 12)], *own])))
    for i in range(80, 160):  # short sets of four shingles and more
        rows.append((i, " ".join(common[draw.randint(0, 2) : draw.randint(7, 24)] + ["z"] * draw.randint(0, 2))))
    expected = brute(rows)
    assert len(expected) > 60 and found(spark, rows) == expected


def test_lines_of_one_boilerplate_do_not_meet(spark):
    draw = random.Random(7)
    common = ["c%d" % i for i in range(60)]
    lines = [" ".join([*common, *("o%d" % draw.randint(0, 10**9) for _ in range(10))]) for _ in range(300)]
    sets = Units([x.encode() for x in lines]).sets()
    rows = [(i, sets[0][a:b].tobytes()) for i, (a, b) in enumerate(zip(sets[1], sets[1][1:]))]
    tables = Tables(spark)
    frame = spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "key long, shingles binary")
    assert paragraphs._sized(paragraphs._rarest(frame, tables)).count() == 0
    tables.drop_all()


def test_lone_pairs_at_the_threshold_are_all_found(spark):
    # 13 words of which the last differs: 8 of 10 shingles; 100 words of which one in the middle differs
    rows = []
    for i in range(400):
        words = ["u%dx%d" % (i, k) for k in range(12)]
        rows += [(2 * i, " ".join([*words, "left"])), (2 * i + 1, " ".join([*words, "right"]))]
    for i in range(400, 600):
        words = ["u%dx%d" % (i, k) for k in range(49)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:20], "other", *words[21:]]))]
    expected = Counter((d, 0, len(t), d - d % 2, d % 2 == 1) for d, t in rows)
    assert found(spark, rows) == expected


def test_short_lines_take_part(spark):
    rows = [(1, "Terms apply.\none two three four five six"), (2, "own words\nTerms  apply!\nx"), (3, "one two three four five six\n\n-- "), (4, "terms"), (4, "terms")]
    assert sorted(found(spark, rows)) == [(1, 0, 12, 1, False), (1, 13, 40, 1, False), (2, 10, 23, 1, True), (3, 0, 27, 1, True)]


def test_empty_table(spark):
    assert repeated_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_and_their_sentences():
    texts = ["One two. Three\n\nNext line.", "", "... -", "É! Ça.\u00a0\u2003Où?\t\nMid.dle \u00a0x. ", "?? \n y"]
    found_ = Units([t.encode() for t in texts])
    assert [(o, texts[o][a:b]) for o, (a, b) in zip(found_.owner.tolist(), found_.ranges.tolist())] == [
        *((0, x) for x in ("One two. Three", "One two.", "Three", "Next line.")),
        *((3, x) for x in ("É! Ça.\u00a0\u2003Où?\t", "É!", "Ça.", "Où?", "Mid.dle \u00a0x. ")),
        (4, " y"),
    ]
    # white space between sentences parts words, elsewhere what is not ASCII belongs to a word
    assert found_.words.tolist() == [3, 2, 1, 2, 3, 1, 1, 1, 3, 1]
    assert Units([]).owner.tolist() == Units([b""]).owner.tolist() == []

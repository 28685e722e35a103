"""Sizes of repeated paragraphs and stretches, and the join of crowded buckets without a row for each shingle."""

import random
from collections import Counter

from cladeflow.llm import paragraphs
from cladeflow.llm.paragraphs import repeated_paragraphs, sized_paragraphs
from cladeflow.llm.shared_files import Tables


def test_passages_are_told_from_short_lines(spark):
    passage = "One two three four five six seven eight nine ten. " * 2 + "Aa bb cc dd ee ff gg hh ii jj kk."
    rows = [(1, "Own words HERE.\nThe end.\n" + passage), (2, "The end.\nOther.\nThe end."), (3, "La!! Own start of a line " + passage + " Own rest")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sized_paragraphs(frame).collect()
    assert Counter(tuple(r)[:5] for r in found) == Counter(tuple(r) for r in repeated_paragraphs(frame).collect())
    text = dict(rows)
    assert {(r.doc_id, text[r.doc_id][r.start : r.end], r.words, r.passage_words, r.passage) for r in found} == {
        (1, "The end.", 2, 33, True),  # the passage follows
        (1, "One two three four five six seven eight nine ten.", 10, 33, True),
        (1, "Aa bb cc dd ee ff gg hh ii jj kk.", 11, 33, True),
        (2, "The end.", 2, 2, False),
        # its first sentence begins before the passage
        (3, "One two three four five six seven eight nine ten.", 10, 21, False),
        (3, "Aa bb cc dd ee ff gg hh ii jj kk.", 11, 21, False),
    }


def test_crowded_sets_have_rows_for_their_first_fifths_alone(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "CROWD", 2)
    draw = random.Random(9)
    sets = [sorted(draw.sample(range(1, 10**6), 100)) for _ in range(40)]
    frame = spark.createDataFrame([(i, bytearray(b"".join(x.to_bytes(8, "little") for x in s))) for i, s in enumerate(sets)], "key long, shingles binary")
    tables = Tables(spark)
    assert 0 < paragraphs._rarest(frame, tables).count() <= 40 * 21
    tables.drop_all()


def test_shingles_are_counted_in_ranges(spark):
    draw = random.Random(10)
    sets = [draw.sample([(k * 0x9E3779B97F4A7C15) % 2**64 for k in range(1, 400)], 50) for _ in range(60)]
    frame = spark.createDataFrame([(bytearray(b"".join(x.to_bytes(8, "little") for x in s)),) for s in sets], "shingles binary").repartition(5)
    blocks = frame.mapInArrow(paragraphs._counted(7), "part long, shingles binary, counts binary")
    found = blocks.groupBy("part").applyInArrow(paragraphs._frequent(8), "shingles binary, counts binary").collect()
    split = lambda x, signed: [int.from_bytes(x[i : i + 8], "little", signed=signed) for i in range(0, len(x), 8)]
    counts = Counter({a: n for r in found for a, n in zip(split(r.shingles, False), split(r.counts, True))})
    assert len(found) == 7 and counts == {a: n for a, n in Counter(x for s in sets for x in s).items() if n > 8}

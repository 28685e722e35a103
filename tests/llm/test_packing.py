import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cladeflow.llm.packing import WordTokenizer, differencing, pack, pack_batch

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_places_every_piece_once(sizes, windows):
    packed = differencing(sizes, windows)
    assert sorted(i for w in packed for i in w) == list(range(len(sizes))) and len(packed) <= windows
    if len(sizes) >= 4 * windows and max(sizes) * windows * 4 <= sum(sizes):
        sums = [sum(sizes[i] for i in w) for w in packed]
        assert max(sums) - min(sums) <= max(sizes)


@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_windows_rise_until_all_fit(sizes):
    packed = pack_batch(sizes, 20)
    assert sorted(i for w in packed for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 20 for w in packed)


def test_ids_equal_the_tokenizers():
    plain, own = Tokenizer.from_file(PATH), WordTokenizer(PATH, 1, limit=40)
    draw = random.Random(1)
    texts = ["".join(map(chr, range(256))), " ".join(map(chr, range(256))), "it's 'SAME İ Σ ΑΣ é 漢字 a²b ***. ..' x.y", "", "<|endoftext|> x", "a\x1cb\x85c", "é É", "don't 'S a'll've"]
    texts += ["".join(draw.choice("ab'.,*\n \tÉé1²ſK") for _ in range(60)) for _ in range(200)]
    for at in range(0, len(texts), 16):
        for text, data in zip(texts[at : at + 16], own.encode(texts[at : at + 16])):
            assert np.frombuffer(data, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids + [1], text


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    out = [(i, " ".join(draw.choice(["the", "cat", "Antidis", "x7."]) for _ in range(draw.randint(0, 900)))) for i in range(150)]
    return out + [(500, None), (501, ""), (502, "word " * 30_000), (None, "no id"), (3, out[3][1])]


def test_round_trip(spark, rows):
    frame = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    pieces = pack(frame, PATH, batch_windows=8).collect()
    plain = Tokenizer.from_file(PATH)
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p["doc_id"]].append(p)
        of_sequence[p["sequence_id"]].append(p)
    for p in of_sequence.values():
        p.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in p] == [sum(y["length"] for y in p[:k]) for k in range(len(p))]
        assert sum(x["length"] for x in p) == p[0]["sequence_tokens"] <= 2048
    for doc, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        times = sum(d == doc for d, _ in rows)
        assert sum(p["length"] for p in of_doc[doc]) == times * len(ids)
        for p in of_doc[doc]:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part.tobytes())
    padded = sum(2048 - p[0]["sequence_tokens"] for p in of_sequence.values()) / 2048 / len(of_sequence)
    assert padded < 0.1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_another_tokenizer_is_not_cut_by_this_ones_rules():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), WordTokenizer(path, 1)
    texts = ["It's  a Test\n\nof x.y 123", "", "é漢"]
    for text, data in zip(texts, own.encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids + [1]

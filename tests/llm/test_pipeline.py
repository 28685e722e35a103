"""The pipeline's stages over the smallest tables, each against a plain version of its decision."""

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cladeflow.llm.queries import tokenizer_path
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_jaccard_join import brute as near_copies
from tests.llm.test_secrets import brute as secrets

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(9001, None, "en", "s", 0), (9002, "123 ...", "en", "s", 7), (9003, docs.first()["text"], "en", "s", 5), (9004, "AKIA" + "Q" * 16 + " that the of and with is on it. Éa", "en", "s", 30)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    before, texts = docs, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).persist()
        was = {r["doc_id"]: r["text"] for r in before.collect()}
        if k < 4:
            assert after.columns == docs.columns
            texts = {r["doc_id"]: r["text"] for r in after.collect()}
        if k == 0:
            assert set(was) - set(texts) >= {9001, 9002} and len(set(was) - set(texts)) <= 4
        if k == 1:
            kept = {doc for doc, least, _ in near_copies(sorted(was.items())) if doc == least}
            assert set(texts) == kept
        if k == 2:
            hit = {i: contamination(t, bench) for i, t in was.items()}
            assert set(texts) == {i for i, (n, h, _, _) in hit.items() if not (h > 0 and 20 * h >= n)}
        if k == 3:
            assert set(texts) == set(was) and not any(secrets(t) for t in texts.values())
            assert all(texts[i] == t for i, t in was.items() if not secrets(t) and "[SECRET]" not in texts[i])
            assert after.filter(F.col("n_chars") != F.length("text")).filter(F.col("text").contains("[SECRET]")).count() == 0
        if k == 4:
            pieces = defaultdict(int)
            for r in after.collect():
                pieces[r["doc_id"]] += r["length"]
            plain = Tokenizer.from_file(tokenizer_path())
            assert pieces == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
        before = after.persist()
    assert np.all(["[SECRET]" in texts[9004]])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_run_packs_what_the_stages_kept(spark):
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() > 50


def test_stages_with_clashing_names_and_odd_rows(spark):
    """Columns that are named like a stage's own or hold dots, null ids and texts, repeated rows, a long text, and no rows."""
    say = "the cat and the dog are in the house and it is not so bad for them to be there with us all day "
    rows = [(1, say, "en", "s", len(say), "k", 1), (2, say + "again", "en", "s", 5, "k", 2), (None, "another text of some words that is not like any other one here", "en", "s", 5, None, 3)]
    rows += [(4, None, "en", "s", 0, "k", 4), (5, "", "en", "s", 0, "k", 5), (6, say.replace("cat", "bird") * 3 + "tail " * 30_000, "en", "s", 9, "k", 6)]
    rows += [(7, "token = abcdefghijklmnop0 " + say[::-1], "en", "s", 9, "k", 7)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, `a.b` int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            after = stage(spark, some, SF)
            if name != "packing":
                assert after.columns == docs.columns
            found = after.collect()
            if some is not docs:
                assert not found
            elif name == "language ID":
                assert {r["doc_id"] for r in found} == {1, 2, None, 6, 7}
            elif name == "n-gram Jaccard join":
                assert sorted((r["doc_id"] or 0, r["a.b"]) for r in found) == [(0, 3), (1, 1), (4, 4), (5, 5), (6, 6), (7, 7)]
            elif name == "secret scans":
                assert sum("[SECRET]" in (r["text"] or "") for r in found) == 2 and len(found) == len(rows)

import random

import numpy as np

from cladeflow.llm.quality import BINS, SPAN, calibrate, fit_quality, score_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(seed, n=500):
    """Bad documents have marks in their text, and nearly always come from one source."""
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        said = [draw.choice(["alpha", "beta", "gamma", "delta"]) + ("" if good else draw.choice(["***", "$$$"])) for _ in range(draw.randint(3, 40))]
        source = draw.choice(["s1", "s2"]) if good == (draw.random() < 0.97) else "s3"
        text = " ".join(said)
        rows.append((i, text, "en", source, len(text), "x"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_with_few_labels(spark):
    rows, labels = corpus(1)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels[:120] + [(7, None), (None, 1), (3, 5)], "doc_id long, quality int")
    found = {r["row"]["doc_id"]: r for r in score_quality(docs, known, ["doc_id"]).collect()}
    assert np.mean([found[i]["good"] == bool(q) for i, q in labels[120:]]) > 0.97
    assert all(0 <= found[i][c] <= 1 for i in found for c in ("score", "p_text", "p_meta"))
    # pseudo-labels taught the metadata view about the telling source
    bad = np.mean([found[r[0]]["p_meta"] for r in rows if r[3] == "s3"])
    assert bad < 0.35


def test_cases(spark):
    rows, labels = corpus(2, 200)
    odd = [(1000, None, None, None, None, None), (1001, "", "en", "s1", 0, "x"), (1002, "alpha " * 200_000, "en", "s1", -5, "x"), (None, "beta", "en", "s1", 4, "x"), (5, rows[5][1], "en", "s1", 3, "y")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    found = score_quality(docs, known, ["doc_id", "score"]).collect()
    assert len(found) == 205 and all(r["score"] is not None for r in found)
    assert score_quality(docs.limit(0), known, ["doc_id"]).count() == 0


def test_one_label_or_none_says_nothing(spark):
    rows, labels = corpus(3, 40)
    docs = spark.createDataFrame(rows, SCHEMA)
    for known in ([], [(i, 1) for i, _ in labels]):
        found = score_quality(docs, spark.createDataFrame(known, "doc_id long, quality int"), ["doc_id"]).collect()
        assert {r["score"] for r in found} == {0.5} and {r["good"] for r in found} == {True}


def test_calibration_recovers_a_logistic_curve():
    x = (np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN
    p = 1 / (1 + np.exp(-(1.5 * x - 0.7)))
    slope, shift = calibrate(1000 * (1 - p), 1000 * p)
    assert abs(slope - 1.5) < 0.01 and abs(shift + 0.7) < 0.01


def test_labels_are_bounded(spark):
    rows, labels = corpus(4, 100)
    model = fit_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), most_labels=0)
    assert model.prior == 0

import random

import numpy as np

from cladeflow.llm.language import codewords, detect_language, fit_languages

WORDS = {"aa": ["kar", "toku", "mira"], "bb": ["shlom", "wrent", "gorth"], "cc": ["éau", "çel", "ùni"]}


def sample(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(list(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(2, 30))), lang))
    return rows


def test_codewords_are_distinct():
    for n in (2, 3, 4, 7, 8, 30):
        code = codewords(n)
        assert len({tuple(r) for r in code}) == n and set(np.unique(code)) == {-1, 1}
        assert all(len(set(c)) == 2 for c in code.T)


def test_held_out_accuracy_and_cases(spark):
    rows = sample(300, 1)
    model = fit_languages(spark.createDataFrame(rows + [(900, None, "aa"), (901, "kar", None)], "doc_id long, text string, lang string"))
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "aa"), (1003, "kar " * 400_000, "aa"), (None, "kar toku", None), (5, "kar toku", "x"), (5, "kar toku", "x")]
    asked = spark.createDataFrame(sample(200, 2) + extra, "doc_id long, text string, lang string").withColumnRenamed("lang", "score")
    found = detect_language(asked, model, ["doc_id", "score"]).collect()
    assert len(found) == 207
    plain = [r for r in found if r["row"]["doc_id"] is not None and r["row"]["doc_id"] < 200 and r["row"]["score"] in WORDS]
    assert np.mean([r["lang_pred"] == r["row"]["score"] for r in plain]) > 0.98
    by = {r["row"]["doc_id"]: r for r in found}
    assert {by[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and by[1000]["score"] == 0
    assert by[1003]["lang_pred"] == by[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in found)


def test_mixture_is_ambiguous(spark):
    model = fit_languages(spark.createDataFrame(sample(300, 1), "doc_id long, text string, lang string"), buckets=1 << 12)
    mixed = spark.createDataFrame([(1, "kar shlom toku wrent mira gorth " * 20), (2, "kar toku mira " * 20)], "doc_id long, text string")
    found = {r["row"]["doc_id"]: r["ambiguous"] for r in detect_language(mixed, model, ["doc_id"], tolerance=0.3).collect()}
    assert found == {1: True, 2: False}


def test_no_label_and_no_row(spark):
    docs = spark.createDataFrame([(1, "kar", None)], "doc_id long, text string, lang string")
    model = fit_languages(docs)
    assert detect_language(docs, model, ["doc_id"]).first()["lang_pred"] == "und"
    assert detect_language(docs.limit(0), model, ["doc_id"]).count() == 0
    one = fit_languages(docs.fillna("aa", ["lang"]))
    assert detect_language(docs, one, ["doc_id"]).first()["lang_pred"] == "aa"

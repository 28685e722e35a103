import random
import re
import string

from cladeflow.llm import secrets
from cladeflow.llm.secrets import find_secrets, mask_secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def corpus():
    draw = random.Random(6)
    key = lambda n, a=string.ascii_letters + string.digits: "".join(draw.choice(a) for _ in range(n))
    texts = [
        None, "", "nothing here", "é😀 token = \"" + key(20) + "\" end", "token: password: " + key(14), "API_KEY='short' apikey=" + key(12) + " x",
        "AKIA" + key(14, string.ascii_uppercase) + " AKIAAKIA" + key(9, string.ascii_uppercase) + "a AKIA123", key(16, "0123456789abcdef") + "g" + key(15, "0123456789abcdef"),
        "secret=" + key(30, "0123456789abcdef"), "😀" * 5 + key(40, "0123456789abcdef") + "\nPASSWD = " + key(12), "x " * 50_000 + key(32, "0123456789abcdef"),
        (key(16, "0123456789abcdef") + " ") * 900, key(40), "plain " + key(44) + "== tail", "aaaaaaaaaa1111111111aaaaaaaaaa1111111111", "abcabcabc123abcabcabc123abcabcabc123abcabcabc123",
    ]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])]


def test_base_equals_brute_force_and_random_strings_are_found(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, hex int")
    found = find_secrets(frame, ["doc_id", "hex"]).collect()
    text = dict(rows[::-1])
    assert len(found) == len(rows)
    for r in found:
        t = text[r["row"]["doc_id"]]
        assert r["base"] == brute(t), t[:80]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [brute(t).count(k + ":") for k in ("assign", "access", "hex")]
        spans = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
        assert [s for s, _ in spans] == sorted(s for s, _ in spans) and set(r["base"].split(",")) <= {"", *r["spans"].split(",")}
    random_ = {r["row"]["doc_id"]: r["n_random"] for r in found}
    assert random_[12] == 1 and random_[13] == 1 and random_[2] == random_[14] == random_[15] == 0


def test_masking_keeps_all_else(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, start string")
    spans = {r["row"]["doc_id"]: r["spans"] for r in find_secrets(frame, ["doc_id"]).collect()}
    text = dict(rows[::-1])
    for r in mask_secrets(frame).collect():
        t = text[r["doc_id"]]
        hidden = sorted(tuple(map(int, s.split(":")[1:])) for s in spans[r["doc_id"]].split(",") if s)
        out, at = "", 0
        for a, b in hidden:
            if b <= at:
                continue
            out += "" if a < at else t[at:a] + "[SECRET]"
            at = b
        assert r["text"] == (None if t is None else out + t[at:]) and r["start"] == "c"


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find_secrets(none, ["doc_id"]).count() == 0 and mask_secrets(none).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    searched = secrets._candidates(secrets._with_spans(frame, "random", secrets.RUN), 80.0)
    for found in (searched, find_secrets(frame, ["doc_id"])):
        assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


def test_running_sums_in_chunks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(secrets, "CHUNK", 3)
    frame = spark.createDataFrame([(list(range(n)),) for n in (1, 3, 4, 11)], "x array<long>")
    for r in frame.select("x", secrets._running(F.col("x")).alias("y")).collect():
        assert r["y"] == [sum(r["x"][:i]) for i in range(len(r["x"]))]

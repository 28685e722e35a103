"""Random keys in runs that no single encoding fits."""

import random
import string

from cladeflow.llm.secrets import find_secrets, mask_secrets


def corpus():
    draw = random.Random(12)
    key = lambda n, more="": "".join(draw.choice(string.ascii_letters + string.digits + more) for _ in range(n))
    a, b, c, d, e, f = key(40), key(19, "+/") + "+" + key(20, "+/"), key(40, "-_") + "==", key(40), key(40), key(40)
    return [
        (f"export AUTH={a} now", [a]), (f"😀 AWS_SECRET_ACCESS_KEY={b}", [b]), (f"https://x.example/get?v=2&sig={c}&n=1", [c]), (f"at build-tools/v2-x/{d} end", [d]),
        (f"A={e}=B={f}", [e, f]), ("some-long/path-to/an-ordinary/file-2=of=the-usual/kind-3", []), ("x=" + "abc123" * 8 + "-/", []),
    ]


def test_keys_after_names_and_among_mixed_separators_are_found_and_masked(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    spans = {r["row"]["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("random")] for r in find_secrets(frame, ["doc_id"]).collect()}
    masked = {r["doc_id"]: r["text"] for r in mask_secrets(frame).collect()}
    for i, (text, keys) in enumerate(rows):
        for key in keys:
            at = text.index(key)
            assert any(s <= at and at + len(key) <= e for s, e in spans[i]), text
            assert key not in masked[i]
        assert keys or not spans[i], text
    assert masked[0] == "export AUTH=[SECRET] now" and masked[1].endswith(" AWS_SECRET_ACCESS_KEY=[SECRET]")
    assert masked[2] == "https://x.example/get?v=2&sig=[SECRET]&n=1"


def test_keys_without_a_known_form_are_found_and_ordinary_strings_left_alone(spark):
    """Recall of planted keys, and the share of ordinary strings among what is reported, by length."""
    draw = random.Random(21)
    letters = string.ascii_letters + string.digits
    words = "request handler config session upload archive static image thumbnail report daily backup service account module index release preview customer invoice".split()
    alphabets = {"url": letters + "-_", "b64": letters + "+/", "alnum": letters, "b32": string.ascii_uppercase + "234567"}

    def ordinary():
        kind, n = draw.randint(0, 3), draw.randint(3, 7)
        some = [draw.choice(words) for _ in range(n)]
        if kind == 0:
            return "-".join(some) + "-v%d" % draw.randint(1, 99)
        if kind == 1:
            return "/".join(some) + "/%d" % draw.randint(1, 99999)
        if kind == 2:
            return "".join(w.capitalize() for w in some) + "%d" % draw.randint(1, 999)
        return "_".join(some).upper() + "_%04d" % draw.randint(0, 9999)

    rows, keys = [], {}
    for i in range(4000):
        parts = [ordinary() for _ in range(3)]
        if i % 20 == 0:
            key = "".join(draw.choice(alphabets[draw.choice(sorted(alphabets))]) for _ in range(1))
            alphabet = alphabets[sorted(alphabets)[(i // 20) % 4]]
            key = "".join(draw.choice(alphabet) for _ in range(draw.choice((32, 40, 48, 64))))
            keys[i] = key
            parts.insert(1, key)
        rows.append((i, "see " + " and ".join(parts) + " there"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r["row"]["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("random")] for r in find_secrets(frame, ["doc_id"]).collect()}
    caught = sum(any(a <= rows[i][1].index(k) + 4 and b >= rows[i][1].index(k) + len(k) - 4 for a, b in told[i]) for i, k in keys.items())
    reported = sum(map(len, told.values()))
    false = sum(not (i in keys and rows[i][1][a:b].strip("=") in keys[i]) for i, spans in told.items() for a, b in spans)
    assert caught >= 0.9 * len(keys) and reported and false <= 0.1 * reported, (caught, len(keys), false, reported)

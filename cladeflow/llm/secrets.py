"""Secret scans: known forms of credentials, and strings that pass a battery of randomness tests.

Spark functions only. A candidate is tested in the encoding that it is written in: chi-squared evenness of its characters,
runs of one class of characters, and serial correlation. The null hypothesis is an ordinary string: characters no more even,
changes of class no more frequent and neighbours no less alike than in names, paths and words. Strings that are shown not to be
ordinary are reported; the share of ordinary ones among them is controlled, among strings of like length and
encoding, by the Benjamini-Hochberg rule, so that short strings need what long ones have to spare. A string that the same
tests show to be no random draw either, such as a count or a repeat, is let go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cladeflow.llm.shared_files import Tables, columns

# The known forms. Each is matched leftmost, without overlap; too short matches are dropped after.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
#: The same matches as runs of ACCESS and HEX that are long enough, without the others in between.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{14,}+", r"(?<![0-9a-f])[0-9a-f]{16,}+"
#: Whole runs that may hold an encoded key.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

#: What a run looks like that some encoding fits. Others come apart at inner "=", and what then mixes "+/" with "-_" into
#: its longest base64 and URL-safe parts.
WHOLE = r"^(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"
SEGMENT, MIXED_PARTS, RUN_LENGTH = r"[A-Za-z0-9+/_-]+=*", (r"[A-Za-z0-9+/]+=*", r"[A-Za-z0-9_-]+=*"), 20

KINDS = ("assign", "access", "hex", "random")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, most special first: name, what a string in it looks like, its alphabet, where its second and later classes of
#: characters begin, and how uneven ordinary strings are at least (``k`` times the sum of squared shares, less 1).
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef", (10,), 0.6),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF", (10,), 0.6),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567", (26,), 1.0),
    ("alphanumeric", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, (26, 52), 2.0),
    ("base64", r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/", (26, 52, 62), 2.0),
    ("url-safe", r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_", (26, 52, 62), 2.0),
)
#: Ordinary strings change class at most so often, of random ones' changes; their neighbours' correlation is this at least.
CHANGES, ALIKE = 0.5, 0.3
#: A random string is let go with this chance.
LET_GO = 1e-3
#: Steps of -log10 p: 20 a decade, none past 30 decades. Bounds the table from which thresholds are taken.
STEPS, MOST = 20, 600
#: Elements whose lengths are added up one by one; longer arrays are summed in chunks of so many.
CHUNK = 256


def _running(lengths: Column) -> Column:
    """Sum of all elements before each one."""
    append = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))
    zero = lambda at: F.struct(at.cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(lengths, c * CHUNK + 1, CHUNK),
    )
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    starts = F.aggregate(sums, zero(F.lit(0)), append)["all"]
    return F.flatten(F.zip_with(chunks, starts, lambda c, s: F.aggregate(c, zero(s), append)["all"]))


def _with_spans(df: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Adds the array column ``kind`` of structs ``start``, ``end`` and ``value`` of the matches in ``text``."""
    df = df.withColumn("_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    if kind == "assign":
        df = df.withColumn("_values", F.when(F.size("_found") > 0, F.regexp_extract_all("text", F.lit(pattern), F.lit(2))))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("text", pattern, -1)))
    gap_and_match = F.zip_with(F.slice("_gaps", 1, F.size("_found")), "_found", lambda g, m: F.length(g) + F.length(m))
    df = df.withColumn("_lengths", F.transform(gap_and_match, lambda x: x.cast("long")))
    df = df.withColumn("_before", F.when(F.size("_found") > 0, _running(F.col("_lengths"))))
    df = df.withColumn(
        "_ends", F.zip_with("_before", "_lengths", lambda b, n: b + n)
    )
    spans = F.zip_with("_ends", "_found", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
    if kind == "assign":
        spans = F.transform(
            F.filter(F.arrays_zip(spans.alias("span"), F.col("_values").alias("part")), lambda x: F.length(x["part"]) >= ASSIGN_VALUE),
            lambda x: x["span"],
        )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return df.withColumn(kind, F.coalesce(spans, empty)).drop("_found", "_values", "_gaps", "_lengths", "_before", "_ends")


def _pieces(value: Column, pattern: str) -> Column:
    """Structs ``start`` and ``value`` of the matches in a string. As they are leftmost, a match is where it is first met
    after the one before."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("all"))

    def append(acc: Column, m: Column) -> Column:
        start = F.position(m, value, acc["at"] + 1) - 1
        return F.struct((start + F.length(m)).alias("at"), F.concat(acc["all"], F.array(F.struct(start.alias("start"), m.alias("value")))).alias("all"))

    return F.aggregate(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), zero, append)["all"]


def _parts(run: Column) -> Column:
    """A run that an encoding fits, or else its parts that one fits; parts of both kinds may overlap."""
    moved = lambda part, by: F.struct((by + part["start"]).alias("start"), part["value"].alias("value"))

    def of_segment(s: Column) -> Column:
        both = F.concat(*[_pieces(s["value"], p) for p in MIXED_PARTS])
        return F.when(s["value"].rlike(WHOLE), F.array(s)).otherwise(F.transform(both, lambda x: moved(x, s["start"])))

    found = F.filter(F.flatten(F.transform(_pieces(run["value"], SEGMENT), of_segment)), lambda x: F.length(x["value"]) >= RUN_LENGTH)
    spans = F.transform(
        found,
        lambda x: F.struct((run["start"] + x["start"]).alias("start"), (run["start"] + x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")),
    )
    return F.when(run["value"].rlike(WHOLE), F.array(run)).otherwise(spans)


def _normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution, by a rational approximation good to 1e-7 or so."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _noncentral_tail(x: Column, free: Column, shift: Column) -> Column:
    """Lower tail of the noncentral chi-squared distribution, by Sankaran's approximation."""
    mean = free + shift
    h = 1 - 2 * mean * (free + 3 * shift) / (3 * (free + 2 * shift) * (free + 2 * shift))
    p = (free + 2 * shift) / (mean * mean)
    m = (h - 1) * (1 - 3 * h)
    z = (F.pow(x / mean, h) - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * F.sqrt(2 * p) * (1 + 0.5 * m * p))
    return _normal_tail(-z)


def _measured(s: Column) -> dict[str, Column]:
    """Statistics of a string's ``codes`` (places in an alphabet of ``k``) and neighbouring ``pairs``."""
    codes, pairs, k = s["codes"], s["pairs"], s["k"]
    n = F.size(codes).cast("double")
    counts = F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.size(F.filter(codes, lambda x: x == c)).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
    class_of = lambda x: F.size(F.filter(s["bounds"], lambda b: b <= x))
    middle = (k - 1).cast("double") / 2
    return {
        "n": n,
        "chi": F.greatest(squares * k / n - n, F.lit(1e-9)),
        "changes": F.aggregate(pairs, F.lit(0.0), lambda a, x: a + (class_of(x["a"]) != class_of(x["b"])).cast("double")),
        "serial": F.aggregate(pairs, F.lit(0.0), lambda a, x: a + (x["a"] - middle) * (x["b"] - middle)) / (n - 1) / ((k * k - 1) / 12),
    }


def _judged(s: Column) -> dict[str, Column]:
    """From those: whether the string is no random draw, and half of Fisher's statistic of the tests whether it is ordinary."""
    n, free = s["n"], (s["k"] - 1).cast("double")
    runs = lambda rate, off: (s["changes"] - off - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate))
    part = 2 / (9 * free)
    uneven = _normal_tail((F.pow(s["chi"] / free, F.lit(1 / 3)) - (1 - part)) / F.sqrt(part))
    regular = 2 * _normal_tail(F.abs(runs(s["rate"], 0)))
    bound = 2 * _normal_tail(F.abs(s["serial"] * F.sqrt(n - 1)))
    p_chi = _noncentral_tail(s["chi"], free, n * s["uneven"])
    p_runs = _normal_tail(runs(s["rate"] * CHANGES, 0.5))
    p_serial = _normal_tail((ALIKE - s["serial"]) * F.sqrt((n - 1) / (1 - ALIKE * ALIKE)))
    logs = [F.log(F.greatest(p, F.lit(1e-300))) for p in (p_chi, p_runs, p_serial)]
    return {"not_random": 3 * F.least(uneven, regular, bound) < LET_GO, "half": -(logs[0] + logs[1] + logs[2])}


def _step(s: Column) -> Column:
    """Steps of -log10 p that the string is ordinary. Fisher's statistic has a chi-squared distribution of six degrees of
    freedom, whose tail is in closed form."""
    half = s["half"]
    told = (half - F.log(1 + half + half * half / 2)) / 2.302585092994046
    return F.when(s["not_random"], 0).otherwise(F.least(F.lit(MOST), F.floor(STEPS * F.greatest(told, F.lit(0.0))).cast("int")))


def _candidates(df: DataFrame, entropy: float) -> DataFrame:
    """Turns the spans in ``random`` into candidates with ``stratum`` (length and encoding) and ``step`` of their p."""
    told = [
        F.struct(
            F.lit(a).alias("alphabet"),
            F.array(*map(F.lit, bounds)).alias("bounds"),
            F.lit(uneven).alias("uneven"),
            F.lit(1 - sum(((hi - lo) / len(a)) ** 2 for lo, hi in zip((0, *bounds), (*bounds, len(a))))).alias("rate"),
        )
        for _, _, a, bounds, uneven in ENCODINGS
    ]
    encodings = F.array(*told)

    def named(s: Column) -> Column:
        at = F.lit(None).cast("int")
        for i, (_, looks, *_) in reversed(list(enumerate(ENCODINGS))):
            at = F.when(s["value"].rlike(looks), i).otherwise(at)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.rtrim(s["value"], F.lit("=")).alias("bare"), at.alias("at"))

    def spelled(s: Column) -> Column:
        of = F.element_at(encodings, s["at"] + 1)
        codes = F.transform(F.split(s["bare"], ""), lambda c: F.instr(of["alphabet"], c) - 1)
        length = F.floor(F.log2(F.length(s["bare"]).cast("double"))).cast("int")
        stratum = (length * len(ENCODINGS) + s["at"]).alias("stratum")
        return F.struct(
            *[s[c].alias(c) for c in ("start", "end")], stratum, F.length(of["alphabet"]).alias("k"), codes.alias("codes"), *[of[c].alias(c) for c in ("bounds", "uneven", "rate")]
        )

    def paired(s: Column) -> Column:
        last = F.size(s["codes"]) - 1
        pairs = F.zip_with(F.slice(s["codes"], 1, last), F.slice(s["codes"], 2, last), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "stratum", "k", "codes", "bounds", "uneven", "rate")], pairs.alias("pairs"))

    def with_(new: dict[str, Column], s: Column, kept: tuple[str, ...]) -> Column:
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "stratum", *kept)], *[x.alias(c) for c, x in new.items()])

    is_mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    mixed = F.filter(F.flatten(F.transform(F.filter("random", is_mixed), _parts)), is_mixed)
    bits = F.array(*[F.lit(len(a).bit_length() - 1) for _, _, a, *_ in ENCODINGS])
    enough = lambda s: s["at"].isNotNull() & (F.length(s["bare"]) * F.element_at(bits, s["at"] + 1) >= entropy)
    candidates = F.filter(F.transform(mixed, named), enough)
    # one after another, so that nothing is computed twice
    measured = F.transform(F.transform(F.transform(candidates, spelled), paired), lambda s: with_(_measured(s), s, ("k", "uneven", "rate")))
    judged = F.transform(measured, lambda s: with_(_judged(s), s, ()))
    return df.withColumn("random", F.transform(judged, lambda s: with_({"step": _step(s)}, s, ())))


def _thresholds(candidates: DataFrame, rate: float) -> dict[int, int]:
    """Of each stratum: the least step at which a string counts as not ordinary, by the Benjamini-Hochberg rule."""
    rows = candidates.select(F.explode("random").alias("c")).groupBy("c.stratum", "c.step").agg(F.count("*").alias("n"))
    by = W.Window.partitionBy("stratum")
    rank = F.sum("n").over(by.orderBy(F.desc("step")))
    total = F.sum("n").over(by)
    rejected = F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("rank") / F.col("total")
    ranked = rows.select("stratum", "step", rank.alias("rank"), total.alias("total")).filter(rejected)
    # at most a row for each encoding and power of two of lengths
    return {r["stratum"]: r["step"] for r in ranked.groupBy("stratum").agg(F.min("step").alias("step")).collect()}


def _scan(docs: DataFrame, carry: list[str], rate: float, entropy: float) -> DataFrame:
    """``row`` and the spans of each kind. Texts are searched once: spans are kept in the shared folder while the thresholds
    of all documents are found."""
    scanned = docs.select(F.struct(*columns(carry)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind, pattern in zip(KINDS, (ASSIGN, LONG_ACCESS, LONG_HEX, RUN)):
        scanned = _with_spans(scanned, kind, pattern)
    held = Tables(docs.sparkSession).store(_candidates(scanned, entropy).select("row", *KINDS))
    limits = _thresholds(held, rate)
    by_stratum = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv]) if limits else F.lit(None).cast("map<int,int>")
    limit = lambda c: F.coalesce(F.try_element_at(by_stratum, c["stratum"]), F.lit(MOST + 1))
    return held.withColumn("random", F.filter("random", lambda c: c["step"] >= limit(c)))


def _joined(*kinds: str) -> Column:
    """``kind:start:end`` of all spans, by start and then by kind as listed."""

    def placed(at: int) -> Column:
        return F.transform(KINDS[at], lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("at"), s["end"].alias("end")))

    spans = [placed(KINDS.index(kind)) for kind in kinds]
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.transform(F.array_sort(F.concat(*spans)), lambda s: F.concat_ws(":", F.element_at(names, s["at"] + 1), s["start"], s["end"]))
    return F.array_join(told, ",")


def find_secrets(docs: DataFrame, carry: list[str], rate: float = 0.05, entropy: float = 80.0) -> DataFrame:
    """``carry`` columns of each document as the struct ``row``, with the numbers of spans of each kind
    (``n_assign``, ``n_access``, ``n_hex``, ``n_random``), ``base`` and ``spans``: comma-joined ``kind:start:end``
    of the known forms and of all kinds, in code points, end exclusive.

    A candidate of the kind ``random`` has letters and digits and at least ``entropy`` bits of its encoding;
    a run of such characters that no encoding fits is tested in parts, which may overlap.
    ``rate`` bounds the expected share of ordinary strings among those reported, in each encoding and range of lengths.
    A null text counts as empty. Repeated rows and other columns do no harm; an
    empty table gives no rows.
    """
    scanned = _scan(docs, carry, rate, entropy)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("row", *counts, _joined(*KINDS[:3]).alias("base"), _joined(*KINDS).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", rate: float = 0.05, entropy: float = 80.0) -> DataFrame:
    """``docs`` with every found span, overlapping ones as one, replaced by ``mask`` in ``text``; a text without
    a span stays as it is, also a null one."""
    names = docs.columns
    scanned = _scan(docs, names, rate, entropy).withColumn("text", F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    plain = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    scanned = scanned.withColumn("_spans", plain)
    kept = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["end"] <= acc["at"], acc
        ).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.when((s["start"] < acc["at"]), F.lit("")).otherwise(
                        F.concat(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))
                    ),
                ).alias("out"),
            )
        ),
    )
    scanned = scanned.withColumn("_kept", F.when(F.size("_spans") > 0, kept))
    rest = F.substring(F.col("text"), (F.col("_kept.at") + 1).cast("int"), F.length("text"))
    masked = F.when(F.col("_kept").isNotNull(), F.concat("_kept.out", rest)).otherwise(F.col("row.text"))
    return scanned.select(*[masked.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names])

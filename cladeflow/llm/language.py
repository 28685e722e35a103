"""Language identification with error-correcting output codes over byte n-grams.

Every language has a codeword; one binary n-gram classifier per bit predicts that bit, and a text gets the
language whose codeword has the least weighted loss. A text whose two best codewords lose about the same is
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.llm.shared_files import columns

GRAM = 3
#: Bytes that are looked up at once: bounds memory, also for very long texts.
SLICE = 1 << 20
UNDETERMINED = "und"


def _letters_table() -> bytes:
    """ASCII letters and everything above 0x7F stay; all else is a blank."""
    return bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


LETTERS = _letters_table()


def gram_codes(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts one after another, and where each text's begin."""
    data = [b" " + " ".join((t or "").lower().encode("utf-8", "replace").translate(LETTERS).decode("utf-8", "replace").split()).encode() + b" " for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    starts = np.append(0, np.cumsum([len(d) for d in data]))
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - (buckets - 1).bit_length())
    return code, starts


def _sums(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weight rows of each text's n-grams, and how many n-grams it has."""
    code, starts = gram_codes(texts, len(weights))
    out = np.zeros((len(texts), weights.shape[1]))
    lengths = np.maximum(np.diff(starts) - GRAM + 1, 0)  # those across two texts don't count
    text_of = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(text_of)) + np.repeat(starts[:-1] - np.append(0, np.cumsum(lengths)[:-1]), lengths)
    for s in range(0, len(at), SLICE):
        owner = text_of[s : s + SLICE]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first]] += np.add.reduceat(weights[code[at[s : s + SLICE]]], first, axis=0)
    return out, lengths


def _parts(texts: list[str | None], most: int = 2 * SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together."""
    a, total = 0, 0
    for b, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language: all distinct splits of up to 7 languages; of more, a fixed draw of
    dense random splits, ten for each bit that numbering the languages takes."""
    if languages <= 7:
        bits = 2 ** max(languages - 1, 0) - 1
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(bits)] for i in range(languages)]).reshape(languages, bits)
    draw = np.random.default_rng(5)
    return draw.permuted(np.tile([1, -1], (10 * languages.bit_length(), languages))[:, :languages], axis=1).T


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # n-gram bucket x bit: log odds of the bit being +1
    trust: np.ndarray  # of each bit, from its accuracy on texts not learnt from
    usual: np.ndarray  # mean size of each bit's log odds per n-gram, on the same texts

    #: n-grams beyond which more text makes a bit no surer
    FULL = 60.0

    def decode(self, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score in 0..1, and the gap to the second best, as a share of what texts of one
        language usually have, for each text."""
        n = np.maximum(counts, 1)[:, None]
        margin = sums / n * np.minimum(n, self.FULL)
        if len(self.languages) == 1:
            return np.zeros(len(sums), int), np.ones(len(sums)), np.ones(len(sums))
        loss = np.stack([(np.logaddexp(0, -margin * row) * self.trust).sum(1) for row in self.code], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        best, second = order[:, 0], order[:, 1]
        rows = np.arange(len(loss))
        gap = loss[rows, second] - loss[rows, best]
        score = 1 / np.exp(np.minimum(loss[rows, best][:, None] - loss, 0)).sum(1)
        differs = self.code[best] != self.code[second]
        usual = (np.minimum(n, self.FULL) * self.usual * self.trust * differs).sum(1)
        return best, score, gap / np.maximum(usual, 1e-12)


def fit_languages(docs: DataFrame, buckets: int = 1 << 13, per_language: int = 20_000) -> LanguageModel:
    """Learn from the ``text`` and ``lang`` of ``docs``; rows where either is null are left out.

    At most about ``per_language`` texts of a language are used (the documented bound of the sample: rows whose
    text hashes lowest); of languages with fewer, all. Four in five give the counts, the others the trust in each bit. N-grams are counted by the tasks, so only the counts of
    ``buckets`` n-grams per language reach the driver. Without any labelled row the model has no language.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((buckets, 0)), np.zeros(0), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))]), F.col("lang"))
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30))
    # one text in five shows how far each bit can be trusted; equal texts stand on one side
    fold = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(5)) == 0
    counts = np.zeros((len(languages), buckets))
    for lang, bucket, n in sample.filter(~fold).mapInArrow(_counter(languages, buckets), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n")).collect():
        counts[lang, bucket] = n
    chance = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.stack([np.log(chance[c > 0].mean(0)) - np.log(chance[c < 0].mean(0)) for c in code.T], axis=1) if code.shape[1] else np.zeros((buckets, 0))
    model = LanguageModel(languages, code, weights.astype(np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    right = sample.filter(fold).mapInArrow(_bit_checker(shared), "bit int, wrong double, size double, n double").groupBy("bit").agg(F.sum("wrong"), F.sum("size"), F.sum("n")).collect()
    for bit, wrong, size, n in right:
        model.usual[bit] = size / max(n, 1)
        model.trust[bit] = np.log((n - wrong + 0.5) / (wrong + 0.5))
    model.trust = np.maximum(model.trust, 0.0)
    if not model.trust.any():  # too few texts to tell
        model.trust = np.ones_like(model.trust)
    model.trust /= max(model.trust.mean(), 1e-12) if len(model.trust) else 1.0
    return model


def _counter(languages: list[str], buckets: int):
    number = {k: i for i, k in enumerate(languages)}

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), [number[k] for k in batch.column(1).to_pylist()]
            for a, b in _parts(texts):
                code, starts = gram_codes(texts[a:b], buckets)
                for i in range(a, b):
                    held = counts.setdefault(of[i], np.zeros(buckets, np.int64))
                    held += np.bincount(code[starts[i - a] : max(starts[i - a], starts[i - a + 1] - GRAM + 1)], minlength=buckets)
        for lang, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), lang), pa.int32()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    return run


def _bit_checker(shared):
    def run(batches):
        model = shared.value
        number = {k: i for i, k in enumerate(model.languages)}
        wrong, size, n = np.zeros(model.code.shape[1]), np.zeros(model.code.shape[1]), 0
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), np.array([number[k] for k in batch.column(1).to_pylist()])
            for a, b in _parts(texts):
                sums, counts = _sums(texts[a:b], model.weights)
                size += np.abs(sums / np.maximum(counts, 1)[:, None]).sum(0)
                wrong += (sums * model.code[of[a:b]] <= 0).sum(0)
                n += b - a
        bits = len(wrong)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits), pa.int32()), pa.array(wrong), pa.array(size), pa.array(np.full(bits, float(n)))], names=["bit", "wrong", "size", "n"])

    return run


def detect_language(docs: DataFrame, model: LanguageModel, carry: list[str], tolerance: float = 0.1) -> DataFrame:
    """``carry`` columns of each document as the struct ``row``, with ``lang_pred``, ``score`` in 0..1 and
    ``ambiguous``: the gap between the two best codewords is under ``tolerance`` of what it usually is. Only ``text`` is looked at, whole. A null text, a text without a letter, or a model without a
    language gives ``und``, score 0, not ambiguous. Repeated rows give repeated results; an empty table none."""
    row = T.StructType([docs.schema[c] for c in carry])
    schema = T.StructType(
        [
            T.StructField("row", row),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType()),
        ]
    )
    text = F.col("text").cast("string")
    asked = docs.select(F.struct(*columns(carry)).alias("row"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                names, scores, doubts = [], [], []
                for a, b in _parts(texts):
                    if not model.languages:
                        names += [UNDETERMINED] * (b - a)
                        scores += [0.0] * (b - a)
                        doubts += [False] * (b - a)
                        continue
                    best, score, gap = model.decode(*_sums(texts[a:b], model.weights))
                    known = [t is not None for t in texts[a:b]]
                    names += [model.languages[i] if k else UNDETERMINED for i, k in zip(best, known)]
                    scores += [float(s) if k else 0.0 for s, k in zip(score, known)]
                    doubts += [bool(k and g < tolerance) for g, k in zip(gap, known)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())],
                    names=["row", "lang_pred", "score", "ambiguous"],
                )

    return asked.mapInArrow(run, schema)

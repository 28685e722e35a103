"""Quality classification by co-training of two views of a document: its text, and its metadata with the layout of the page.

Each view has a binary classifier over hashed features. In every round a classifier labels the documents it is sure of,
and these train the other one; then both are calibrated anew on labelled documents kept from training. A view that these
documents show to be worse than in the round before stays as it was. The score of a document joins the calibrated views.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.llm.shared_files import columns

VIEWS = ("text", "meta")
BUCKETS = {"text": 1 << 13, "meta": 1 << 12}
#: Raw scores are counted in so many bins from -SPAN to SPAN for calibration.
BINS, SPAN = 400, 4.0
#: Characters that are looked at together.
SLICE = 1 << 21
#: One labelled document in so many calibrates and does not train.
FOLD = 5


@dataclass
class View:
    weights: np.ndarray | None = None  # log odds of good quality per feature
    slope: float = 0.0  # calibrated log odds are slope * raw + shift
    shift: float = 0.0
    loss: float = float("inf")  # on the labels kept for calibration

    def log_odds(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * raw + self.shift, -12, 12)


@dataclass
class QualityModel:
    views: dict[str, View] = field(default_factory=lambda: {v: View() for v in VIEWS})
    prior: float = 0.0  # log odds of good quality among labelled documents
    tell: float = float(np.log(0.95 / 0.05))  # log odds from which a view is sure

    def raw(self, texts: list[str | None], meta: np.ndarray) -> dict[str, np.ndarray]:
        """Mean weight of each document's features, by view; 0 where it has none."""
        out = {"meta": self.views["meta"].weights[meta].mean(1)}
        sums = np.zeros(len(texts))
        for i, codes in enumerate(text_codes(texts)):
            if len(codes):
                sums[i] = self.views["text"].weights[codes].mean()
        return {"text": sums} | out

    def joined(self, raw: dict[str, np.ndarray]) -> np.ndarray:
        return sum(self.views[v].log_odds(raw[v]) for v in VIEWS) - self.prior


def text_codes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of each text, with case and marks."""
    shift = np.uint32(32 - (BUCKETS["text"] - 1).bit_length())
    for text in texts:
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        code *= np.uint32(2654435761)
        yield code >> shift


#: Fields of the table, and the layout: characters a line, characters a word, marks, and lines that stand in the text before.
META = ("source", "lang", "n_chars", "line", "word", "mark", "again")


def _layout(text: Column) -> list[Column]:
    """Bins of the last four of META, null where the text is."""
    lines = F.split(text, "\n")
    n, length = F.size(lines).cast("double"), F.greatest(F.length(text), F.lit(1)).cast("double")
    words = length - F.length(F.translate(text, " ", "")) + 1
    marks = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]+", ""))
    return [F.floor(2 * F.log2(length / n)), F.floor(4 * F.log2(length / words)), F.floor(50 * marks / length), F.floor(20 * (n - F.size(F.array_distinct(lines))) / n)]


def _prepared(docs: DataFrame, labels: DataFrame, most_labels: int, carry: list[str]) -> DataFrame:
    """Documents with their hashed metadata and, where they are in the sample of labels, their label and fold."""
    labels = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label"))
    labels = labels.filter("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    sample = labels.orderBy(F.xxhash64("_id"), "_id").limit(most_labels)  # at most most_labels rows are broadcast
    size = F.floor(F.log2(F.coalesce(F.col("n_chars").cast("double"), F.lit(-1.0)) + 2)).cast("string")
    text = F.col("text").cast("string")
    shape = _layout(text)
    found = dict(zip(META, [F.col("source"), F.col("lang"), size, *[F.when(text.isNotNull(), c) for c in shape]]))
    named = [F.concat(F.lit(f"{c}="), F.coalesce(x.cast("string"), F.lit("?"))) for c, x in found.items()]
    rows = docs.select(
        F.struct(*columns(carry)).alias("row"),
        F.col("doc_id").cast("long").alias("_id"),
        text.alias("text"),
        F.array(*[F.pmod(F.xxhash64(c), F.lit(BUCKETS["meta"])).cast("int") for c in named]).alias("meta"),
    )
    rows = rows.join(F.broadcast(sample), "_id", "left")
    return rows.select("row", "text", "meta", "_label", (F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLD)) == 0).alias("calibrates"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    """Parts of about SLICE characters, with texts and metadata."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        meta = np.array(batch.column(batch.schema.get_field_index("meta")).to_pylist(), np.int64).reshape(-1, len(META))
        a, total = 0, 0
        for b, t in enumerate(texts, 1):
            total += len(t or "")
            if total >= SLICE or b == len(texts):
                yield batch.slice(a, b - a), texts[a:b], meta[a:b]
                a, total = b, 0


COUNTS = "view int, feature int, label int, n long"


def _rows(found: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (view, label), held in found.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), view), pa.int32()), pa.array(at, pa.int32()), pa.array(np.full(len(at), label), pa.int32()), pa.array(held[at], pa.int64())],
            names=["view", "feature", "label", "n"],
        )


def _count(found: dict, view: int, label: int, codes: np.ndarray) -> None:
    name = VIEWS[view]
    held = found.setdefault((view, label), np.zeros(BUCKETS[name], np.int64))
    held += np.bincount(codes.ravel(), minlength=BUCKETS[name])


def _labelled_counts(batches):
    found: dict = {}
    for part, texts, meta in _batches(batches):
        label = part.column(part.schema.get_field_index("_label")).to_pylist()
        for i, codes in enumerate(text_codes(texts)):
            _count(found, 0, label[i], codes)
            _count(found, 1, label[i], meta[i])
    yield from _rows(found)


def _told_counts(shared):
    """Features of unlabelled documents of which one view is sure, counted for the other view."""

    def run(batches):
        model, found = shared.value, {}
        for _, texts, meta in _batches(batches):
            raw = model.raw(texts, meta)
            odds = {v: model.views[v].log_odds(raw[v]) for v in VIEWS}
            by_text, by_meta = (np.where(np.abs(odds[v]) >= model.tell, (odds[v] > 0).astype(int), -1) for v in VIEWS)
            for label in (0, 1):
                if (by_text == label).any():
                    _count(found, 1, label, meta[by_text == label])
            for i in np.flatnonzero(by_meta >= 0).tolist():
                for codes in text_codes([texts[i]]):
                    _count(found, 0, int(by_meta[i]), codes)
        yield from _rows(found)

    return run


def _score_bins(shared):
    def run(batches):
        model, found = shared.value, {}
        for part, texts, meta in _batches(batches):
            label = np.array(part.column(part.schema.get_field_index("_label")).to_pylist())
            for view, (_, raw) in enumerate(sorted(model.raw(texts, meta).items(), key=lambda x: VIEWS.index(x[0]))):
                at = np.clip(((raw + SPAN) / (2 * SPAN) * BINS).astype(int), 0, BINS - 1)
                for k in (0, 1):
                    held = found.setdefault((view, k), np.zeros(BINS, np.int64))
                    held += np.bincount(at[label == k], minlength=BINS)
        yield from _rows(found)

    return run


def _collected(counts: DataFrame, sizes: dict[int, int]) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all tasks; as many rows as there are features, whatever the input."""
    out = {(v, k): np.zeros(sizes[v], np.int64) for v in sizes for k in (0, 1)}
    for view, feature, label, n in counts.groupBy("view", "feature", "label").agg(F.sum("n")).collect():
        out[view, label][feature] = n
    return out


def calibrate(n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the label on the raw score, from counts by bin, with slopes held a little towards 0."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN
    n, good = n0 + n1, n1 + 0.0
    design, theta = np.stack([x, np.ones(BINS)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (good - n * p) - np.array([0.02, 0.02]) * theta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([0.02, 0.02])
        step = np.linalg.solve(hessian, gradient)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def log_loss(view: View, n0: np.ndarray, n1: np.ndarray) -> float:
    odds = view.log_odds((np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN)
    return float((n0 * np.logaddexp(0, odds) + n1 * np.logaddexp(0, -odds)).sum())


def fit_quality(docs: DataFrame, labels: DataFrame, rounds: int = 2, most_labels: int = 50_000) -> QualityModel:
    """Co-train on ``labels`` (doc_id, quality 0 or 1) and all of ``docs``.

    At most ``most_labels`` labelled rows are used (the documented bound; those whose ids hash lowest), one in five of them
    for calibration only. Pseudo-labels come from all other documents. Only counts of hashed features reach
    the driver. A label of null or another value is left out; of several for a document the lowest counts. Without
    both labels the model says nothing, and every score is 0.5.
    """
    rows = _prepared(docs, labels, most_labels, ["doc_id"]).drop("row")
    context = docs.sparkSession.sparkContext
    labelled, other = rows.filter("_label is not null"), rows.filter("_label is null")
    train, rest = labelled.filter("not calibrates"), labelled.filter("calibrates")
    sizes = {i: BUCKETS[v] for i, v in enumerate(VIEWS)}
    base = _collected(train.mapInArrow(_labelled_counts, COUNTS), sizes)
    model = QualityModel()
    told = {k: np.zeros_like(v) for k, v in base.items()}
    for turn in range(rounds + 1):
        if turn:
            told = _collected(other.mapInArrow(_told_counts(context.broadcast(model)), COUNTS), sizes)
        fresh = QualityModel()
        for i, v in enumerate(VIEWS):
            bad, good = (base[i, k] + told[i, k] + 0.5 for k in (0, 1))
            fresh.views[v].weights = np.log(good / good.sum()) - np.log(bad / bad.sum())
        bins = _collected(rest.mapInArrow(_score_bins(context.broadcast(fresh)), COUNTS), {0: BINS, 1: BINS})
        n0, n1 = bins[0, 0].sum(), bins[0, 1].sum()
        if n0 and n1 and base[0, 0].sum() and base[0, 1].sum():
            fresh.prior = float(np.log(n1 / n0))
            for i, v in enumerate(VIEWS):
                fresh.views[v].slope, fresh.views[v].shift = calibrate(bins[i, 0], bins[i, 1])
                fresh.views[v].loss = log_loss(fresh.views[v], bins[i, 0], bins[i, 1])
                # what the other view told must help on labels that neither has learnt from
                if fresh.views[v].loss > model.views[v].loss:
                    fresh.views[v] = model.views[v]
        model = fresh
    return model


def score_quality(docs: DataFrame, labels: DataFrame, carry: list[str], rounds: int = 2, most_labels: int = 50_000) -> DataFrame:
    """``carry`` columns of each document as the struct ``row``, with ``p_text`` and ``p_meta`` (the calibrated views),
    ``score`` (both joined) and ``good`` (a score of 0.5 or more).

    Metadata are ``source``, ``lang`` and ``n_chars``, and how the text is laid out (lengths of lines and words, shares of
    marks and of repeated lines); null ones are values of their own. A null or empty text leaves the
    text view without a feature. Repeated rows give repeated results; an empty table none.
    """
    model = fit_quality(docs, labels, rounds, most_labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = T.StructType([docs.schema[c] for c in carry])
    doubles = ("p_text", "p_meta", "score")
    schema = T.StructType([T.StructField("row", row)] + [T.StructField(c, T.DoubleType()) for c in doubles])

    def run(batches):
        model = shared.value
        for part, texts, meta in _batches(batches):
            raw = model.raw(texts, meta)
            odds = [*(model.views[v].log_odds(raw[v]) for v in VIEWS), model.joined(raw)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(1 / (1 + np.exp(-o))) for o in odds)], names=["row", *doubles])

    asked = _prepared(docs, labels.limit(0), 0, carry).select("row", "text", "meta")
    return asked.mapInArrow(run, schema).withColumn("good", F.col("score") >= 0.5)

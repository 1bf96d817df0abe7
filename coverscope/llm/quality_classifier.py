"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model fitted by dual coordinate descent.

Features are the distinct byte n-grams (1 to 3 bytes, upper and lower case kept, since
capitals and symbol runs tell) of the whole text, hashed to 2**18 places. The model is
fitted on a bounded sample of the labelled rows: the max_train ones with the smallest
hash of their id, one text each. Everything else covers all rows.

A null text counts as an empty one; an empty text has no features and gets the score of
the intercept. Rows with a null label aren't learned from. Without any label, or with
one class alone, there is nothing to separate: every score is then that class's share
(0.5 without labels). Repeated rows get equal scores. Columns named quality_score and
quality_predicted give way to the result's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.llm.shared import crc_remainder, schema_of

BITS = 18
SIZES = (1, 2, 3)


def grams(text: str | None, mark: np.ndarray) -> np.ndarray:
    """The places of the text's distinct n-grams, ascending. mark: 2**BITS False values, given back as such."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    value = np.zeros(len(b), np.uint32)
    for n in SIZES:
        if len(b) < n:
            break
        value = value[: len(b) - n + 1] * np.uint32(256) + b[n - 1 :]
        mark[(value * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS)] = True
    places = np.flatnonzero(mark)
    mark[places] = False
    return places


@dataclass
class Model:
    weights: np.ndarray  # of each place, the log-count ratio included
    squares: np.ndarray  # of the ratios: their sum over a text's places is its squared length
    intercept: float
    slope: float
    shift: float

    def score(self, places: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[places].sum())) or 1.0
        margin = float(self.weights[places].sum()) / length + self.intercept
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, alpha: float) -> np.ndarray:
    counts = []
    for wanted in (True, False):
        own = [r for r, g in zip(rows, good, strict=True) if g == wanted]
        n = alpha + np.bincount(np.concatenate(own), minlength=1 << BITS)
        counts.append(n / n.sum())
    return np.log(counts[0] / counts[1])


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Weights (the last one is the intercept) of the hinge-loss model: one dual variable at a time, in a new order each epoch."""
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    size = np.array([float(v @ v) + 1 for v in values])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            gradient = sign[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - gradient / size[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[rows[i]] += step * values[i]
                w[-1] += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-4:
            break
    return w


def sigmoid_fit(margins: np.ndarray, good: np.ndarray) -> float:
    """The slope of a logistic curve through 0 at margin 0, fitted to softened labels by Newton's method."""
    n1, n0 = good.sum(), (~good).sum()
    target, slope = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins, -30, 30)))
        change = ((target - p) * margins).sum() / ((p * (1 - p) * margins**2).sum() + 1e-6)
        slope = min(max(slope + np.clip(change, -2, 2), 0.1), 20.0)
        if abs(change) < 1e-4:
            break
    return float(slope)


def fit(rows: list[np.ndarray], good: np.ndarray, alpha: float = 1.0, cost: float = 10.0, epochs: int = 20, seed: int = 7) -> Model:
    zero = np.zeros(1 << BITS, np.float32)
    if len(set(good.tolist())) < 2:
        share = float(good.mean()) if len(good) else 0.5
        return Model(zero, zero, 0.0, 1.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    ratio = log_count_ratio(rows, good, alpha)
    values = [v / (np.sqrt(v @ v) or 1.0) for v in (ratio[r] for r in rows)]
    sign = np.where(good, 1.0, -1.0)
    # either class weighs as much as the other
    costs = cost * len(good) / (2 * np.where(good, good.sum(), (~good).sum()))
    w = descend(rows, values, sign, costs, epochs, seed)
    margins = np.array([w[r] @ v for r, v in zip(rows, values, strict=True)]) + w[-1]
    return Model((w[:-1] * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(w[-1]), sigmoid_fit(margins, good), 0.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark = np.zeros(1 << BITS, bool)
    for b in batches:
        out = [grams(t, mark).astype(np.int32).tobytes() for t in b["text"].to_pylist()]
        yield pa.record_batch({"doc_id": b["doc_id"], "good": b["good"], "places": pa.array(out, pa.binary())})


def train(docs: DataFrame, labels: DataFrame, max_train: int = 4000) -> Model:
    """docs: doc_id and text; labels: doc_id and quality. Learns from ids whose crc32 remainder by 3 isn't 1."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), 3) != 1))
        .groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text")
    # of an id with several rows the first by its features is learned from: max_train rows come to the driver at most
    each = sample.mapInArrow(_features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, good boolean, places binary").groupBy("doc_id").agg(F.first("good").alias("good"), F.min("places").alias("places"))
    got = each.select("good", "places").toPandas().sort_values(["places", "good"])
    return fit([np.frombuffer(x, np.int32) for x in got.places], got.good.to_numpy(bool))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1) and quality_predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2**18 floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, m = np.zeros(1 << BITS, bool), shared.value
        for b in batches:
            scores = np.array([m.score(grams(t, mark)) for t in b[text].to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], [*b.schema.names, "quality_score", "quality_predicted"])

    kept = docs.drop("quality_score", "quality_predicted")
    return kept.mapInArrow(score, f"{schema_of(kept)}, quality_score double, quality_predicted int")

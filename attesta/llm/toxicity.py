"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of the lower-cased text between blanks, hashed to 2**bits places.
The log-count ratio of a feature compares the shares of toxic and other documents that hold it; a
logistic regression is trained on the features multiplied by these ratios. It is fitted on at most
per_class labelled documents of each class, of at most class_bytes bytes in all (documented bounds;
the documents come in the order of the hashes of their ids), the two classes weighing the same.
Documents are counted in several tasks, whose counts are added by ranges of features; features that
are rare or near even are dropped before any document's features are gathered for the fit.

Every text is scored whole. Empty and null texts have no features and get the intercept's score;
without labels of both classes all scores are 0 (nothing toxic is known) or 1 (nothing else is).
Of several rows with one labelled doc_id, one (the shortest, then the smallest hash) is learned from.
A column of docs that is named like the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from attesta.llm.arrays import give_back, lean, mix32, steps
from attesta.llm.labels import held_out, label_sample, labelled_texts

ORDERS = (3, 4, 5, 6)
BITS = 20
#: Features that are counted together, and tasks that the bounded sample is dealt to.
RANGE, TASKS = 1 << 16, 8


def ngram_ids(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS, seen: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed n-grams of a text, unordered. seen: scratch space of 2**bits int32."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h, parts = np.zeros(len(points), np.uint32), []
    for n in range(1, max(orders) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1:]
        if n in orders:
            parts.append(mix32(h + np.uint32(n)) >> np.uint32(32 - bits))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if seen is None:
        return np.unique(ids)
    order = np.arange(len(ids), dtype=np.int32)
    seen[ids] = order
    return ids[seen[ids] == order]


@dataclass
class Model:
    """score = sigmoid(bias + sum of weights[f] over the features f)."""

    weights: np.ndarray
    bias: float


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_count_ratios(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log of the share of toxic documents with a feature over that of others; 0 for rare or near even features, which tell little."""
    ratio = np.log((with_1 + 1) / (n1 + 2)) - np.log((with_0 + 1) / (n0 + 2))
    ratio[(with_1 + with_0 < 3) | (np.abs(ratio) < 1)] = 0
    return ratio


def fit(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, ratio: np.ndarray, norm: float, rounds: int = 100, l2: float = 1e-3, chunk: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on features scaled by ratio * norm, by Adam; the two classes weigh the same.

    flat: the features of all documents one after another, sizes: how many each has. Both sums of a
    round run over chunks of features, so that their temporary arrays stay small.
    """
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    weight, scale = np.where(y == 1, 0.5 / n1, 0.5 / n0), ratio * norm
    rows = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    cuts = range(0, len(flat), chunk)
    w, b = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z, gw, scaled = np.full(len(y), b), l2 * w * norm, w * scale
        for i in cuts:
            z += np.bincount(rows[i:i + chunk], weights=scaled[flat[i:i + chunk]], minlength=len(y))
        g = weight * (_sigmoid(z) - y)
        for i in cuts:
            gw += np.bincount(flat[i:i + chunk], weights=g[rows[i:i + chunk]], minlength=len(w)) * scale
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.3 / (1 + t / 20)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w * scale, b


def _counted(texts: DataFrame) -> DataFrame:
    """at, known (uint32) and ratio (float64): of each range of RANGE features from place at, those kept."""
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = np.zeros(1 << BITS, np.int32), np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for part in steps(batch, "_text"):
                for text, y in zip(part["_text"].to_pylist(), part["y"].to_pylist(), strict=True):
                    counts[y][ngram_ids(text or "", seen=seen)] += 1
        for at in range(0, 1 << BITS, RANGE):
            if counts[:, at:at + RANGE].any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), *(pa.array([c[at:at + RANGE].tobytes()], pa.binary()) for c in counts)], ["at", "with_0", "with_1"])

    def add(t: pa.Table) -> pa.Table:
        with_0, with_1 = (sum(np.frombuffer(x, np.int32) for x in t[name].to_pylist()) for name in ("with_0", "with_1"))
        ratio = log_count_ratios(with_1, with_0, n[1], n[0])
        known = np.flatnonzero(ratio)
        at = t["at"][0].as_py()
        return pa.table({"at": [at], "known": pa.array([(at + known).astype(np.uint32).tobytes()], pa.binary()), "ratio": pa.array([ratio[known].tobytes()], pa.binary())})

    return texts.repartition(TASKS).mapInArrow(lean(count), "at bigint, with_0 binary, with_1 binary").groupBy("at").applyInArrow(add, "at bigint, known binary, ratio binary")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 5000, class_bytes: int = 32 << 20, folds: int = 5, fold: int = 0) -> Model:
    """Fit on a bounded sample of labelled documents. One task gets the kept features of the sample, the driver their ratios and weights (at most 2**BITS)."""
    sample, sizes = label_sample(labels, "toxic", per_class, folds, fold)
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 60.0 if 1 in sizes else -60.0)
    texts = labelled_texts(docs, sample, class_bytes)
    if texts.select("y").distinct().count() < 2:  # the labelled documents are not among docs
        return Model(np.zeros(1 << BITS, np.float32), -60.0)
    kept = sorted(_counted(texts).collect(), key=lambda r: r["at"])
    known = np.concatenate([np.frombuffer(r["known"], np.uint32) for r in kept])
    ratio = np.concatenate([np.frombuffer(r["ratio"], np.float64) for r in kept])
    sent = docs.sparkSession.sparkContext.broadcast((known, ratio))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, place = np.zeros(1 << BITS, np.int32), np.full(1 << BITS, -1, np.int32)
        place[sent.value[0]] = np.arange(len(sent.value[0]), dtype=np.int32)
        for batch in batches:
            for part in steps(batch, "_text"):
                found = [ngram_ids(t or "", seen=seen) for t in part["_text"].to_pylist()]
                ids = [place[x] for x in found]
                yield pa.RecordBatch.from_arrays([part["_doc"], part["y"], pa.array([len(x) for x in found]), pa.array([x[x >= 0].tobytes() for x in ids], pa.binary())], ["doc", "y", "n", "ids"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch[name].to_pylist() for name in ("doc", "y", "n", "ids")), strict=True)
        rows.sort()  # the same sums whatever order the rows come in
        ids = [np.frombuffer(x, np.int32) for *_, x in rows]
        norm = 1 / np.sqrt(max(1, np.median([n for _, _, n, _ in rows])))
        weights, bias = fit(np.concatenate(ids), np.array([len(x) for x in ids]), np.array([y for _, y, _, _ in rows]), sent.value[1], norm)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    sparse = texts.repartition(TASKS).mapInArrow(lean(features), "doc bigint, y int, n bigint, ids binary")
    got = sparse.repartition(1).mapInArrow(lean(fitted), "weights binary, bias double").first()
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = np.frombuffer(got["weights"], np.float64)
    return Model(weights, got["bias"])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of docs, and the score of each whole text. The weights are a table of fixed size, so they are broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        weights, bias = sent.value
        seen, z = np.zeros(1 << BITS, np.int32), []
        for part in steps(pa.RecordBatch.from_arrays([texts], ["_text"]), "_text"):
            z += [bias + float(weights[ngram_ids(t or "", seen=seen)].sum(dtype=np.float64)) for t in part["_text"].to_pylist()]
        give_back()
        return pa.array(_sigmoid(np.array(z, np.float64)))

    return docs.withColumn(score, scored(F.col(text)))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score at least threshold; same columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score_toxicity(docs, train(docs, labels), score=name).where(F.col(name) < threshold).drop(name)

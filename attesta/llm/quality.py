"""Quality: Bradley-Terry ranking of documents from preference pairs.

A document labelled good is preferred to one labelled bad. The score is linear in features of the
whole text; its weights minimise the logistic loss over the differences of the pairs' features
(Newton's method, ridge penalty). The threshold is the quantile of the labelled documents' scores
that leaves the share of good labels above it; the reported score is a logistic curve with 0.7
there. Fitted on all labelled documents outside the fold: their features are stored, dealt to groups
by a hash of the id, and each document of the larger class meets some of the other of its group; a
step of Newton's method is one pass over the groups. Features are clipped to 8 standard deviations, in fitting and scoring.
A column of docs that is named like the score is replaced by it.
Empty and null texts have the features of a text of no words. Without labels of both classes the
score is 1 if only good ones are known, else 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from attesta.llm.arrays import steps
from attesta.llm.labels import held_out, label_rows
from attesta.session import materialize

FEATURES = 20

_CLASS = np.zeros(256, np.int64)  # of bytes: other, letter, digit, common punctuation, symbol, blank, line feed, capital
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A"):ord("Z") + 1] = 7
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_CLASS[ord(" ")] = 5
_CLASS[ord("\n")] = 6


def text_features(text: str | None) -> list[float]:
    """Features of one whole text: shares of kinds of characters, repetition of words, pairs and lines, lengths."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size = max(1, len(raw))
    kinds = np.bincount(_CLASS[raw], minlength=8) / size
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    lines_again = 1 - len(set(lines)) / max(1, len(lines))
    symbols = kinds[4]
    return [
        *kinds, symbols**0.5, np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n, len(counts) / n, len(counts) / n**0.5, max(counts.values(), default=0) / n,
        pairs / n, same / n, (same / n) ** 0.5, lines_again, len(lines) / n,
    ]


@dataclass
class Ranking:
    """score = sigmoid(weights . (features - mean) / scale - threshold + log(0.7 / 0.3))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + np.log(0.7 / 0.3), -60, 60)))


def _differences(z: np.ndarray, y: np.ndarray, pairs_each: int) -> np.ndarray:
    """Features of the better minus those of the worse: each document of the larger class meets pairs_each of the other, in a fixed rotation."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros((0, z.shape[1]))
    most = max(len(good), len(bad))
    i = np.tile(np.arange(most), pairs_each)
    turn = np.repeat(np.arange(pairs_each) * 7919, most)
    better, worse = (good[i % len(good)], bad[(i + turn) % len(bad)]) if len(good) >= len(bad) else (good[(i + turn) % len(good)], bad[i % len(bad)])
    return z[better] - z[worse]


def _moments(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of the loss's gradient and of its curvature over pairs, and their number."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # of the worse one winning
    return np.concatenate([-(d * p[:, None]).sum(0), ((d * (p * (1 - p))[:, None]).T @ d).ravel(), [len(d)]])


def _newton(size: int, moments, ridge: float) -> np.ndarray:
    w = np.zeros(size)
    for _ in range(25):
        m = moments(w)
        n = max(1.0, m[-1])
        step = np.linalg.solve(m[size:-1].reshape(size, size) / n + ridge * np.eye(size), m[:size] / n + ridge * w)
        w = w - step * min(1, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_pairs(x: np.ndarray, y: np.ndarray, share_good: float, pairs_each: int = 10, ridge: float = 1e-3) -> Ranking:
    """The fit of one group, in one process."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = _differences(np.clip((x - mean) / scale, -8, 8), y, pairs_each)
    w = _newton(x.shape[1], lambda w: _moments(d, w), ridge)
    ranking = Ranking(mean, scale, w, 0.0)
    s = ranking.raw(x)
    order = np.argsort(s, kind="stable")
    weight = np.where(y == 1, share_good / len(good), (1 - share_good) / len(bad))[order]
    below = np.searchsorted(np.cumsum(weight), 1 - share_good - 1e-9)
    ranking.threshold = float((s[order][min(below, len(s) - 1)] + s[order][min(below + 1, len(s) - 1)]) / 2)
    return ranking


def _featured(texts: pa.Array) -> np.ndarray:
    """One row of features a text, made in steps of bounded bytes."""
    parts = [np.array([text_features(t) for t in part["_text"].to_pylist()], np.float64) for part in steps(pa.RecordBatch.from_arrays([texts], ["_text"]), "_text")]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


@F.arrow_udf(ArrayType(DoubleType()))
def _features(texts: pa.Array) -> pa.Array:
    x = _featured(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.reshape(-1)))


def labelled_features(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """_doc, y and x of all labelled documents, stored. One row a doc_id: its shortest text, of the smallest hash."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    # features are sent, not texts; a merge join at any size
    made = docs.select("doc_id", size.alias("size"), F.xxhash64("text").alias("hash"), _features("text").alias("x"))
    met = made.join(rows.hint("merge"), "doc_id").withColumnRenamed("doc_id", "_doc")
    return materialize(met.groupBy("_doc").agg(F.first("y").alias("y"), F.min(F.struct("size", "hash", "x")).alias("row")).select("_doc", "y", "row.x"), "quality-features")


#: Documents of a group, and of its smaller class, to expect.
GROUP, FEWEST = 2048, 64


def fit_all(features: DataFrame, sizes: dict[int, int], share_good: float, pairs_each: int = 10, ridge: float = 1e-3) -> Ranking:
    """fit_pairs over all rows (_doc, y, x): pairs are made within groups, sums over groups added up. sizes: rows of each class."""
    each = [F.element_at("x", i + 1) for i in range(FEATURES)]
    of = features.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(each)]).first()
    mean, scale = (np.array([round(of[f"{n}{i}"], 12) for i in range(FEATURES)]) for n in "ms")
    scale[scale < 1e-9] = 1
    n = max(1, min(min(sizes.values()) // FEWEST, sum(sizes.values()) // GROUP))
    row = F.struct(F.xxhash64("_doc").alias("hash"), "_doc", "y", "x")
    groups = features.groupBy(F.pmod(F.xxhash64("_doc"), F.lit(n)).alias("g")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    groups = materialize(groups.select(F.transform("r", lambda r: r["y"]).alias("y"), F.flatten(F.transform("r", lambda r: r["x"])).alias("x")), "quality-groups")

    def moments(w: np.ndarray) -> np.ndarray:
        def run(batches):
            total = 0.0
            for batch in batches:
                for y, x in zip(batch["y"], batch["x"], strict=True):
                    z = np.clip((x.values.to_numpy().reshape(-1, FEATURES) - mean) / scale, -8, 8)
                    total = total + _moments(_differences(z, y.values.to_numpy(), pairs_each), w)
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

        sums = groups.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])])

    # sums differ in their last digits with the order of tasks
    ranking = Ranking(mean, scale, np.round(_newton(FEATURES, moments, ridge), 6), 0.0)

    @F.arrow_udf(DoubleType())
    def raw(x: pa.Array) -> pa.Array:
        return pa.array(np.round(ranking.raw(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)), 9))

    ranking.threshold = quantile(features.select("y", raw("x").alias("s")), {1: share_good / sizes[1], 0: (1 - share_good) / sizes[0]}, 1 - share_good - 1e-9)
    return ranking


def quantile(scored: DataFrame, weights: dict[int, float], share: float, most: int = 4096) -> float:
    """Between the first score (s) at which the weights of the classes (y) of the scores up to it reach the share, and the next. The range is narrowed by counts until at most so many scores are left."""
    good = F.sum(F.col("y").cast("long"))
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    before = 0.0
    weigh = lambda r: r["good"] * weights[1] + (r["n"] - r["good"]) * weights[0]
    while True:
        inside = scored.where((F.col("s") >= low) & (F.col("s") <= high))
        width = (high - low) / 1024
        if width < 1e-9 or inside.select("s").distinct().count() <= most:
            break
        bins = inside.groupBy(F.least(F.floor((F.col("s") - low) / width), F.lit(1023)).alias("b")).agg(F.count("*").alias("n"), good.alias("good"), F.min("s").alias("first"), F.max("s").alias("last")).orderBy("b").collect()
        for r in bins:
            if before + weigh(r) >= share or r is bins[-1]:
                low, high = r["first"], r["last"]
                break
            before += weigh(r)
    rows = inside.groupBy("s").agg(F.count("*").alias("n"), good.alias("good")).orderBy("s").collect()
    for r in rows:
        before += weigh(r)
        if before >= share or r is rows[-1]:
            # of equal scores some may be behind the place
            if r["n"] > 1 and before - max(weights.values()) >= share:
                return float(r["s"])
            after = scored.where(F.col("s") > r["s"]).agg(F.min("s")).first()[0]
            return float(r["s"] if after is None else (r["s"] + after) / 2)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> Ranking | float:
    """Fit on all labelled documents outside the fold; the driver gets sums only."""
    rows, known = label_rows(labels, "quality", folds, fold)
    if len(known) < 2:
        return 1.0 if 1 in known else 0.0
    features = labelled_features(docs, rows)
    sizes = {r["y"]: r["n"] for r in features.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return 1.0 if 1 in sizes else 0.0
    return fit_all(features, sizes, known[1] / sum(known.values()))


def score_quality(docs: DataFrame, ranking: Ranking | float, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of docs, and the score of each whole text."""
    if not isinstance(ranking, Ranking):
        return docs.withColumn(score, F.lit(ranking))

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(ranking.score(_featured(texts)))

    return docs.withColumn(score, scored(F.col(text)))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs that score at least threshold; same columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score_quality(docs, train(docs, labels), score=name).where(F.col(name) >= threshold).drop(name)

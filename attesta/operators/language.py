"""Language identification learned from labelled texts: naive Bayes over runs of three characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import materialize

#: Bytes of text that a task takes at once, and runs that it counts before it sends the counts on.
STEP, HELD = 1 << 20, 1 << 21
#: Profiles of at most this many different runs are broadcast (about 100 bytes and 30 a language each); larger ones are joined by a shuffle.
BROADCAST_RUNS = 200_000


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def trigrams(text: Column) -> Column:
    """All runs of three characters of a lower-cased text between two spaces, repeats kept: one a character; null and empty texts have none."""
    low = _low(text)
    chars = F.array(F.split(F.concat(F.lit(" "), low, F.lit(" ")), ""))  # in an array, so that the text is split once and not for each run
    starts = F.when(F.length(low) > 0, F.sequence(F.lit(0), F.length(low) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(chars, lambda c: F.transform(starts, lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))))


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about STEP bytes of text, one row at least."""
    step = np.cumsum(pc.fill_null(pc.binary_length(batch["low"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // STEP
    cuts = np.flatnonzero(np.diff(step, prepend=-1))
    for a, z in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
        yield batch.slice(a, z - a)


def run_codes(lowered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The runs of lower-cased texts, one text after another, as numbers of three code points of 21 bits; and how many each text has."""
    texts = pc.fill_null(lowered, "")
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = n > 0
    # a space before and behind each text that has characters; a run for each character between
    joined = "".join([f" {t} " for t in texts.to_pylist() if t])
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    middle = np.ones(len(c), bool)
    ends = np.cumsum(n[full] + 2)
    middle[ends - 1] = middle[ends - n[full] - 2] = False
    at = np.flatnonzero(middle)
    return c[at - 1] << 42 | c[at] << 21 | c[at + 1], n


def run_text(codes: np.ndarray) -> pa.Array:
    c = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], 1).astype(np.uint32)
    chars = c.tobytes().decode("utf-32-le")
    return pa.array([chars[i:i + 3] for i in range(0, len(chars), 3)], pa.string())


def run_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, run and c: how often the texts of a language hold a run; a task counts its own before it sends them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                c = np.bincount(which, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), run_text(codes), pa.array(c)], ["lang", "run", "c"])
            held.clear()

        size = 0
        for batch in batches:
            for part in _steps(batch):
                for name in part["lang"].unique().to_pylist():
                    codes, n = np.unique(run_codes(part["low"].filter(pc.equal(part["lang"], name)))[0], return_counts=True)
                    held.setdefault(name, []).append((codes, n))
                    size += len(codes)
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    own = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), _low(F.col(text)).alias("low")).mapInArrow(run, "lang string, run string, c bigint")
    return own.groupBy("lang", "run").agg(F.sum("c").alias("c"))


def language_profile(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """run, and gains (lang, gain) of the languages that it was seen in; what a language gives for any run at all is under the run ''.

    A run weighs floor(1000 * ln((c + 1) / (C + V))) where c of a language's C runs are this one and V different runs are known in all; its gain is what
    that is above the weight of a run not seen. Rows without a language are left out; without any labelled text the profile is empty.
    """
    counts = materialize(run_counts(labelled, text, lang), "language-counts")
    known = counts.agg(F.count_distinct("run")).first()[0]
    sizes = counts.groupBy("lang").agg((F.sum("c") + known).alias("size"))
    weight = lambda c: F.floor(1000 * F.log((c + 1) / F.col("size")))
    seen = counts.join(F.broadcast(sizes), "lang").select("run", "lang", (weight(F.col("c")) - weight(F.lit(0))).alias("gain"))
    every = seen.unionByName(sizes.select(F.lit("").alias("run"), "lang", weight(F.lit(0)).alias("gain")))
    return materialize(every.groupBy("run").agg(F.collect_list(F.struct("lang", "gain")).alias("gains")), "language-profile")


def _sums_in_tasks(docs: DataFrame, profile: DataFrame, key: str, text: str) -> DataFrame:
    """_key, lang and score of each key and language, by a profile that tasks hold whole."""
    held = profile.select("run", F.explode("gains").alias("g")).select("run", "g.lang", "g.gain").toArrow()
    names = sorted(set(held["lang"].to_pylist()))
    base = dict(zip(*(held.filter(pc.equal(held["run"], ""))[c].to_pylist() for c in ("lang", "gain")), strict=True))
    seen = held.filter(pc.not_equal(held["run"], ""))
    codes, at = np.unique(_codes_of(seen["run"].to_pylist()), return_inverse=True)
    gains = np.zeros((len(codes) + 1, len(names)), np.int64)  # the last row: runs that no language has
    gains[at, [names.index(x) for x in seen["lang"].to_pylist()]] = seen["gain"].to_numpy()
    known = docs.sparkSession.sparkContext.broadcast((codes, gains, np.array([base[x] for x in names], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, gains, base = known.value
        for batch in batches:
            for part in _steps(batch):
                own, n = run_codes(part["low"])
                different, which = np.unique(own, return_inverse=True)
                place = np.searchsorted(codes, different)
                place[place == len(codes)] = 0
                place[codes[place] != different if len(codes) else slice(None)] = len(codes)
                place = place[which]
                full = np.flatnonzero(n)
                ends = np.cumsum(n)[full]
                # a language at a time, so that no row for each run and language is held
                scores = [np.diff(np.cumsum(gains[:, j][place])[ends - 1], prepend=0) + n[full] * base[j] for j in range(len(names))]
                keys = part["_key"].take(pa.array(full))
                for name, score in zip(names, scores, strict=True):
                    yield pa.RecordBatch.from_arrays([keys, pa.array([name] * len(full), pa.string()), pa.array(score)], ["_key", "lang", "score"])

    lowered = docs.select(F.col(key).alias("_key"), _low(F.col(text)).alias("low"))
    return lowered.mapInArrow(run, f"_key {docs.schema[key].dataType.simpleString()}, lang string, score bigint").groupBy("_key", "lang").agg(F.sum("score").alias("score"))


def _codes_of(runs: list[str]) -> np.ndarray:
    c = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, 3)
    return c[:, 0] << 42 | c[:, 1] << 21 | c[:, 2]


def identify(docs: DataFrame, profile: DataFrame, key: str = "doc_id", text: str = "text", fallback: str = "en") -> DataFrame:
    """key and language of each row: the one of the greatest sum of weights, on ties the first by name; the fallback for texts without characters.

    The key tells rows apart: those that share one, null too, are judged as one text and stay one row each; other columns play no part. A task sums
    a row's runs before they are sent. With an empty profile all rows get the fallback.
    """
    if profile.count() <= BROADCAST_RUNS:
        sums = _sums_in_tasks(docs, profile, key, text)
    else:
        found = trigrams(F.col(text))
        parts = F.when(F.size(found) > 0, F.concat(F.transform(found, lambda r: F.struct(r.alias("run"), F.lit(1).alias("times"))), F.array(F.struct(F.lit("").alias("run"), F.size(found).alias("times")))))
        runs = docs.select(F.col(key).alias("_key"), F.explode(parts).alias("p")).select("_key", "p.run", "p.times").groupBy("_key", "run").agg(F.sum("times").alias("times"))
        sums = runs.join(profile, "run").select("_key", "times", F.explode("gains").alias("g")).groupBy("_key", F.col("g.lang").alias("lang")).agg(F.sum(F.col("g.gain") * F.col("times")).alias("score"))
    best = sums.groupBy("_key").agg(F.min(F.struct(-F.col("score"), F.col("lang").alias("lang"))).alias("b"))
    named = docs.select(F.col(key).alias(key)).join(best, F.col(key).eqNullSafe(F.col("_key")), "left")
    return named.select(key, F.coalesce("b.lang", F.lit(fallback)).alias("language"))

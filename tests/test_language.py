"""Learned language identification against plain Python, and its accuracy on documents it was not learned from."""

import collections
import math
import os

import pytest
from pyspark.sql import functions as F

from attesta.operators import language

SCHEMA = "doc_id bigint, text string, lang string"
ROWS = [
    (1, "The cat sat on the mat", "en"), (2, "the dog and THE end", "en"), (3, "le chat est dans la maison", "fr"), (4, "la fin de l'été", "fr"), (5, "der Hund und die Katze", "de"),
    (6, "über die Straße", "de"), (7, "no language here", None), (8, None, "en"), (9, "", "fr"), (10, "x", None), (11, "ΩΩΩ", None), (12, "a\nb  c", "de"), (12, "le la les", None), (None, "und", None), (None, "the", "en"),
    (13, "the cat " * 3000, None), (14, "😀 und 😀", "de"), (1, "The cat sat on the mat", "en"),
]


def runs(text):
    low = f" {(text or '').lower()} "
    return [low[i:i + 3] for i in range(len(low) - 2)]


def plain(rows, judged):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        if lang is not None:
            counts[lang].update(runs(text))
    counts = {k: c for k, c in counts.items() if c}
    known = len(set().union(*counts.values())) if counts else 0
    weight = {k: lambda r, c=c: math.floor(1000 * math.log((c[r] + 1) / (sum(c.values()) + known))) for k, c in counts.items()}
    texts = collections.defaultdict(list)
    for key, text, _ in judged:
        texts[key] += runs(text)
    best = {key: min((-sum(map(w, rs)), k) for k, w in weight.items())[1] if rs and weight else "en" for key, rs in texts.items()}
    return sorted(((key, best[key]) for key, _, _ in judged), key=repr)


@pytest.mark.parametrize("limit", [language.BROADCAST_RUNS, 0])
def test_against_plain_python(spark, monkeypatch, limit):
    monkeypatch.setattr(language, "BROADCAST_RUNS", limit)
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({"run": F.lit("x"), "gains": F.lit(1), "_key": F.lit(2)})
    got = language.identify(docs, language.language_profile(docs))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(ROWS, ROWS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    profile = language.language_profile(docs)
    assert language.identify(docs.where("false"), profile).count() == 0
    assert {r.language for r in language.identify(docs, language.language_profile(docs.where("lang IS NULL"))).collect()} == {"en"}
    assert len(language.identify(docs, language.language_profile(docs.where("false"))).collect()) == len(ROWS)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    got = language.identify(docs.where(held), language.language_profile(docs.where(~held)))
    right = got.join(docs.select("doc_id", "lang"), "doc_id").agg(F.count("*"), F.avg((F.col("language") == F.col("lang")).cast("double"))).first()
    print(right)
    assert right[0] > 100 and right[1] > 0.95


def test_runs_are_counted_in_tasks(spark, monkeypatch):
    """No row for each run of a text: what is dealt out was summed in a task, also when a task's texts come in many steps."""
    monkeypatch.setattr(language, "STEP", 5)
    docs = spark.createDataFrame([(i, "ab" * i, "xy"[i % 2]) for i in range(9)] + [(9, "😀é", "x"), (10, None, "y")], "doc_id int, text string, lang string")
    want = docs.where("text IS NOT NULL").select("lang", F.explode(language.trigrams(F.col("text"))).alias("run")).groupBy("lang", "run").count()
    assert sorted(map(tuple, language.run_counts(docs, "text", "lang").collect())) == sorted(map(tuple, want.collect()))
    plan = language.identify(docs, language.language_profile(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan

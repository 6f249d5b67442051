"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest

from attesta.llm import resample

SCHEMA = "doc_id bigint, text string"


def brute(docs, target, max_words, n_buckets, percent, min_words, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [" ".join(words[i:i + n]) for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = [0] * n_buckets, [0] * n_buckets
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            for f in features(text)[1]:
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + n_buckets) / ((s[b] + 1) * (sum(t) + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for k, text in docs:
        n, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "été", "Éa", "漢字", "x1", "it's", "a-b", "_", "ß", "🙂", "\x7fq", "9"]
    return [(i - 3, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize(("max_words", "n_buckets", "nodes"), [(1, 10_000, 150_000), (2, 97, 150_000), (3, 1000, 5)])
def test_equals_brute_force(spark, monkeypatch, max_words, n_buckets, nodes):
    monkeypatch.setattr(resample, "NODES", nodes)
    docs = [*corpus(1, 120), (500, None), (501, ""), (502, "!?"), (None, "beta " * 30), (None, "beta " * 30), (7, "beta " * 25), (7, "beta " * 25), (7, "x1 " * 25), (503, "漢字 beta " * 20_000)]
    target = [(i, t) for i, t in corpus(2, 30)] + [(99, None)]
    a = spark.createDataFrame(docs, SCHEMA).selectExpr("doc_id", "text", "doc_id AS _row", "text AS rank", "text AS _key").repartition(3)
    got = resample.importance_resample(a, spark.createDataFrame(target, SCHEMA), max_words=max_words, n_buckets=n_buckets, percent=25, seed="s").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, max_words, n_buckets, 25, 20, "s")


def test_ranges_are_numbered_on(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", 10)
    docs, target = corpus(3, 150), corpus(4, 9)
    got = resample.importance_resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(target, SCHEMA), percent=60).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, 1, 10_000, 60, 20, "2024")


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a " * 30), (2, "b")], SCHEMA)
    assert resample.resample_report(none, some).collect() == []
    got = resample.importance_resample(some, none).collect()
    assert sorted(map(tuple, got), key=str) == brute([(1, "a " * 30), (2, "b")], [], 1, 10_000, 10, 20, "2024")
    assert {r.rank for r in got} == {None}


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(corpus(5, 100), SCHEMA).selectExpr("doc_id", "text", "1 AS _drawn", "2 AS rank")
    ranked = resample.importance_resample(docs, docs.limit(5), percent=50)
    kept = resample.drawn(docs, ranked)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in ranked.where("rank IS NOT NULL").collect()} != set()


def test_the_draw_leans_to_the_target(spark):
    docs = spark.createDataFrame([(i, ("sun moon star sky " if i % 4 == 0 else "mud clay dirt ash ") * 10) for i in range(400)], SCHEMA)
    ranked = resample.importance_resample(docs, spark.createDataFrame([(1, "sun moon star sky " * 50)], SCHEMA), percent=20)
    rows = ranked.where("rank IS NOT NULL").collect()
    assert len(rows) == 80 and sum(r.doc_id % 4 == 0 for r in rows) >= 70  # a fourth without weights; the noise lets a few others in


def test_key_of_a_result_column_is_refused(spark):
    with pytest.raises(ValueError):
        resample.importance_resample(spark.createDataFrame([(1, "a")], "rank int, text string"), spark.createDataFrame([], SCHEMA), key="rank")

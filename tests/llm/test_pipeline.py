"""The pipeline's stages one after another, against brute force on a small corpus with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_matching import brute_near, brute_windows

import corpus_pipeline

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, start bigint, doc string, score double, _found string"


def cut_repeats(rows):
    """Texts without the bytes of 50-byte strings that a smaller id also has."""
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if k is not None else 0):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], k), k)
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49 if k is not None else 0):
            if first[b[p:p + 50]] < k:
                gone[p:p + 50] = True
        out.append((k, np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("ra", "lo", "mi", "ta")]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, item = text(30), text(14)
    rows = []
    for i in range(120):
        t = text(rnd.randint(20, 50))
        if i % 6 == 0:
            t += " " + rnd.choice(["vilescum", "rottenfool"])
        if i % 9 == 1:
            t += " " + passage
        if i % 11 == 2:
            t += " " + item
        rows.append((i, t))
    rows += [(200, rows[3][1]), (201, rows[3][1] + " end"), (202, None), (203, ""), (204, "é"), (None, "lone words here"), (205, "x" * 5000)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1, "d", 0.5, "f") for k, t in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def test_stages_against_brute_force(spark, corpus):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    folder, rows, item = corpus
    want = [(k, t) for k, t in rows if not any(w in (t or "") for w in ("vilescum", "rottenfool"))]
    kept = brute_near([(k, t) for k, t in want if k is not None])
    want = [(k, t) for k, t in want if k is None or kept[k][2]]
    want = cut_repeats(want)
    clean = {r[0] for r in brute_windows(want, [(1, item)]) if not r[-1]}
    want = [(k, t) for k, t in want if k in clean]
    from attesta.llm.bpe import read_ranks

    with open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        known = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    ids = {k: known.encode_ordinary(t) for k, t in want}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(ids)
    for k, t in want:
        assert list(got[k].ids) == ids[k] and got[k].n_tokens == len(ids[k]) and got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids[k])).encode()).hexdigest()


def test_every_stage_takes_odd_and_empty_tables(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.where("doc_id >= 200 OR doc_id IS NULL").unionByName(docs.where("doc_id = 202"))
    empty = docs.where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.collect() == [], name
        got = stage(spark, odd, folder)
        if name != "byte_bpe":
            assert got.columns == docs.columns, name
        assert {r.doc_id for r in got.select("doc_id").collect()} >= {None, 202, 203, 204}, name


def test_held_out_labels_leave_the_pipeline_alone(spark, corpus, tmp_path):
    folder, _, _ = corpus
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    kept = lambda where: {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, where).select("doc_id").collect()}
    assert kept(folder) == kept(str(tmp_path))

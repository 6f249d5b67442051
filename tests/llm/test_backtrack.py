"""The backtracking encoder against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import pytest

from attesta.llm import backtrack

SCHEMA = "doc_id bigint, text string"
ODD = [(1, "a"), (2, None), (3, ""), (3, ""), (3, "It's  here\nnow "), (None, "x" * 64), (4, "é漢🙂" * 9000), (-5, "<|endoftext|>a <|endoftext|><|endoftext|"), (6, "<|endof"), (7, "text|>"), (8, " \0\x1c\x85　  x"), (9, "ab" * 40_000)]


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def known(path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def codec(path):
    return backtrack.Backtracking(backtrack.file_bytes(path))


def coded(codec, texts):
    raw = [t.encode() for t in texts]
    ids, at, back, ends = codec.encode_all(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return [(ids[a:z].tolist(), back[x:y].tobytes()) for a, z, x, y in zip(at, at[1:], ends, ends[1:])]


def same(codec, known, texts):
    for t, (ids, back), want in zip(texts, coded(codec, texts), known.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == want.ids
        assert back.decode() == t == known.decode(want.ids, skip_special_tokens=False)


def test_random_texts_equal_the_library(codec, known):
    rnd = random.Random(3)
    letters = " \n\t\r\x0b\x1c\x85\xa0\0aébß漢1२'sd!?.…🙂‍́ 　"
    same(codec, known, ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(1500)])
    same(codec, known, ["".join(rnd.choice(["a", "aa", "in", "er", "re", "ing", "tion", "A", "e", "st", "<|endoftext|>"]) for _ in range(rnd.randint(1, 40))) for _ in range(3000)])


def test_each_token_and_runs_of_tokens_equal_the_library(codec, known):
    texts = [t.decode() for t in codec.ranks if (t.decode("utf-8", "ignore")).encode() == t]
    assert len(texts) > 49_000
    same(codec, known, texts)
    rnd = random.Random(4)
    same(codec, known, ["".join(rnd.choice(texts) for _ in range(rnd.randint(2, 9))) for _ in range(5000)])


def test_all_kinds_of_characters_are_split_as_the_library_does(codec, known):
    same(codec, known, [f"{c}a 1{c} {c}{c}b{c}\n" for c in map(chr, [*range(0x3100), *range(0xD7A0, 0xD800), *range(0xE000, 0x10000, 7), *range(0x10000, 0x20000, 61)])])


def test_compatible_pairs_are_what_merging_keeps(codec, known):
    rnd = random.Random(5)
    tokens = [t for t in codec.ranks if t.isalpha() and len(t) < 5]
    seen = set()
    for _ in range(4000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        fits = codec.compatible(codec.ranks[a], codec.ranks[b])
        assert fits == (known.encode((a + b).decode(), add_special_tokens=False).ids == [codec.ranks[a], codec.ranks[b]])
        seen.add(fits)
    assert seen == {True, False}


def test_long_matches_take_linear_time(codec):
    rnd = random.Random(6)
    took = []
    for n in (50_000, 400_000):
        text = "".join(rnd.choice("abcdefgh") for _ in range(n))
        began = time.perf_counter()
        coded(codec, [text])
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]  # 8 times the bytes


def test_a_full_table_of_pairs_changes_nothing(path, known, monkeypatch):
    monkeypatch.setattr(backtrack, "PAIRS", 3)
    same(backtrack.Backtracking(backtrack.file_bytes(path)), known, ["antidisestablishmentarianism qwertyuiop zxcvb"] * 2)


def test_digests_of_odd_rows(spark, path, known):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = backtrack.backtrack_digests(df.withColumn("ids", df.text).withColumn("decoded", df.text), path).collect()
    want = []
    for k, t in ODD:
        ids = known.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert backtrack.backtrack_digests(spark.createDataFrame([], SCHEMA), path).collect() == []
    with pytest.raises(ValueError):
        backtrack.backtrack_round_trip(df.withColumnRenamed("doc_id", "ids"), "text", "ids", path)


def test_ids_decode_and_added_tokens_can_be_plain_text(spark, path, known):
    df = spark.createDataFrame([(1, "so <|endoftext|> it"), (2, None), (3, "")], SCHEMA)
    ids = backtrack.backtrack_round_trip(df, "text", "doc_id", path)
    assert {r.doc_id: bytes(r.decoded) for r in backtrack.backtrack_decode(ids, "ids", "doc_id", path).collect()} == {1: b"so <|endoftext|> it", 2: b"", 3: b""}
    plain = {r.doc_id: r.ids for r in backtrack.backtrack_round_trip(df, "text", "doc_id", path, special=False).collect()}
    known.encode_special_tokens = True
    try:
        assert plain[1] == known.encode("so <|endoftext|> it", add_special_tokens=False).ids
    finally:
        known.encode_special_tokens = False


def test_files_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        backtrack.read_vocabulary(b'{"pre_tokenizer": null, "model": {}}')

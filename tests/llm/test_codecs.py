"""Media, tokens and shards: exact round trips and fixed formats."""

import hashlib
import random
import struct
import uuid
import zlib

import numpy as np
import pytest

from attesta.llm import bpe, media, training_order as order

SCHEMA = "doc_id bigint, text string"
ODD = [(1, "a"), (2, None), (3, ""), (3, ""), (None, "x" * 64), (4, "é漢🙂" * 9000), (5, "BM GIF89a RIFF %PDF- PK\x03\x04 ftyp")]


def png() -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b";"


@pytest.mark.parametrize(("item", "kind"), [(png(), "image/png"), (GIF, "image/gif"), (media.to_wav(b"abcd"), "audio/wav"), (b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x03x\x11\xff\0\x22\xff\xd9", "image/jpeg"), (b"%PDF-1.4\nstartxref\n9\n%%EOF", "application/pdf"), (struct.pack(">I4s4s", 12, b"ftyp", b"isom") + struct.pack(">I4s", 8, b"moov"), "video/mp4")])
def test_items_are_found_whole_anywhere(item, kind):
    assert media.find_media(b"..BM.." + item + b"tail")[0] == (kind, 6, len(item))
    assert not [x for x in media.find_media(item[:-1]) if x[0] == kind and x[2] >= len(item)]


def test_broken_structure_is_rejected():
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.find_media(bytes(broken)) == []
    assert media.find_media(b"") == []


def test_declared_types_are_corrected_and_items_carved(spark):
    df = spark.createDataFrame([(1, bytearray(png() + GIF), "text/html"), (2, bytearray(GIF), "image/gif"), (3, None, None), (4, bytearray(b"plain"), "text/plain")], "k int, b binary, t string")
    got = {r.k: r for r in media.sniff_media(df, "b", "t", "k").collect()}
    assert (got[1].detected, got[1].corrected, len(got[1]["items"])) == ("image/png", True, 2)
    assert (got[2].corrected, got[3].detected, got[4]["items"]) == (False, media.UNKNOWN, [])
    carved = media.carve_media(df.join(media.sniff_media(df, "b", "t", "k"), "k").where("k = 1"), "b", "items").collect()
    assert sorted(bytes(r.carved) for r in carved) == sorted([png(), GIF])


def test_media_round_trip(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows = media.media_digests(df.withColumn("media", df.text)).collect()
    assert len(rows) == len(ODD)
    want = {}
    for k, t in ODD:
        raw = (t or "").encode()
        body = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        want[k] = (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(body) + 44)
    for r in rows:
        raw = dict(ODD)[r.doc_id] or ""
        body = raw.encode() + b"\0" * (-len(raw.encode()) % 64 or (64 if not raw else 0))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(body)).hexdigest()
        centred = [x - 128 for x in body]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(centred, centred[1:]))
        assert r.feature == f"audio/wav;audio/wav@0+{len(body) + 44};mean={sum(centred) / len(body):.3f},rms={(sum(x * x for x in centred) / len(body)) ** 0.5:.3f},peak={max(map(abs, centred))},crossings={crossings},values={len(set(body))}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == want[r.doc_id]
    assert media.media_digests(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return path, P.PATTERN, bpe.read_ranks(f.read())


def test_bpe_equals_tiktoken(vocabulary):
    import tiktoken

    _, pattern, ranks = vocabulary
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    letters = " \n\t\r\x0b\x1c\x85\xa0\0aébß漢1२'sd!?.…🙂‍́ 　"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(500)] + ["a" * 3000, "  \n\n x", " ", "ab" * 999 + "é", "It's  here\nnow "]
    codec = bpe.Codec(ranks, pattern)
    ids, at, back, ends = coded_texts(codec, texts)
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == known.encode_ordinary(t) == codec.encode(t).tolist()
        assert back[ends[i]:ends[i + 1]].tobytes() == t.encode()


def coded_texts(codec, texts):
    raw = [t.encode() for t in texts]
    return codec.encode_all(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


@pytest.mark.parametrize("other", [r"\w+|\W", r"[^ ]+ ?| +", r"(?s:.{1,100})"])
def test_other_patterns_are_matched_over_whole_texts(vocabulary, other):
    import tiktoken

    _, _, ranks = vocabulary
    known = tiktoken.Encoding("own", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    texts = ["It's here\nnow a b", " x y", "", "élan vital " * 40]
    ids, at, _, _ = coded_texts(bpe.Codec(ranks, other), texts)
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(4)] == [known.encode_ordinary(t) for t in texts]


def test_many_trees_merge_like_one(vocabulary):
    _, pattern, ranks = vocabulary
    rnd = random.Random(2)
    raw = ["".join(rnd.choice("aenthoséß ") for _ in range(rnd.randint(1, 30))).encode() for _ in range(400)]
    raw = [x for x in raw if len(x) <= 64]
    ids, counts = bpe.Codec(ranks, pattern)._merge_many(raw)
    at = np.concatenate([[0], np.cumsum(counts)])
    small = {k: v for k, v in ranks.items()}
    assert [bpe.merge_bytes(x, small) if x not in ranks else None for x in raw] == [ids[at[i]:at[i + 1]].tolist() if x not in ranks else None for i, x in enumerate(raw)]


def test_colliding_hashes_are_noticed(vocabulary, monkeypatch):
    _, pattern, ranks = vocabulary
    texts = ["one two three", "four five", "six seven eight"]
    want = [bpe.Codec(ranks, pattern).encode(t).tolist() for t in texts]
    monkeypatch.setattr(bpe, "mix64", lambda x: x % np.uint64(2))
    ids, at, _, _ = coded_texts(bpe.Codec(ranks, pattern), texts)
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(3)] == want


def test_table_of_keys_grows():
    table = bpe.Table(4)
    keys = (np.arange(1, 3001) * 64).astype(np.uint64)
    for a in range(0, 3000, 500):
        table.add(keys[a:a + 500], np.arange(a, a + 500))
    assert (table.find(keys) == np.arange(3000)).all() and (table.find(keys + np.uint64(1)) == -1).all()


def test_bpe_merges_the_leftmost_of_equal_ranks():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3}
    assert bpe.merge_bytes(b"aaab", ranks) == [2, 3]
    with pytest.raises(KeyError):
        bpe.merge_bytes(b"c", ranks)


def test_full_cache_changes_nothing(vocabulary, monkeypatch):
    _, pattern, ranks = vocabulary
    texts = [f"w{i} x{i % 7}.\nThe end" for i in range(300)]
    want = coded_texts(bpe.Codec(ranks, pattern), texts)[0].tolist()
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    codec = bpe.Codec(ranks, pattern)
    got = [x for i in range(0, 300, 30) for x in coded_texts(codec, texts[i:i + 30])[0].tolist()]
    assert got == want


def test_bpe_digests(spark, vocabulary):
    path, pattern, _ = vocabulary
    rows = bpe.bpe_digests(spark.createDataFrame(ODD, SCHEMA), path, pattern).collect()
    texts = {k: (t or "") for k, t in ODD}
    assert len(rows) == len(ODD)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    coded = bpe.bpe_encode(spark.createDataFrame(ODD, SCHEMA), "text", "doc_id", path, pattern)
    assert bpe.bpe_digests(spark.createDataFrame([], SCHEMA), path, pattern).collect() == []
    clash = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as ids", "2 as decoded", "3 as _key")
    assert sorted(bpe.bpe_digests(clash, path, pattern).collect(), key=str) == sorted(rows, key=str)
    with pytest.raises(ValueError, match="named ids"):
        bpe.bpe_encode(clash, "text", "ids", path, pattern)
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.bpe_decode(coded, "ids", "doc_id", path, pattern).collect()} == texts


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1000, 4097])
def test_feistel_is_a_keyed_bijection(n):
    x = np.arange(n)
    assert (np.sort(order.feistel(x, n, 1)) == x).all()
    assert n < 100 or (order.feistel(x, n, 1) != order.feistel(x, n, 2)).any()


def test_shards_round_trip_and_resume(spark, tmp_path):
    rows = [*ODD, (9, "y" * 2048), *((i, "z" * (i % 300)) for i in range(100, 160))]
    df = spark.createDataFrame(rows, SCHEMA)
    out = f"file://{tmp_path}/{uuid.uuid4().hex}"
    manifest = order.write_shards(df, out, length=128, shard_sequences=32)
    got = order.read_shards(manifest).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, {})[r.place] = bytes(r.tokens)
    assert {k: b"".join(v[i] for i in sorted(v)) for k, v in by.items()} == {k: (t or "").encode() for k, t in rows}
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert sorted(r.slot for r in order.read_shards(manifest, 40, 70).collect()) == list(range(40, 71))
    assert order.write_shards(df, out, length=128, shard_sequences=32).collect() == manifest.collect()
    assert order.write_shards(spark.createDataFrame([], SCHEMA), out + "e").collect() == []


def test_shards_hold_ids(spark, tmp_path):
    rows = [(1, [1, 50_000, 65_535]), (2, None), (3, []), (None, [7] * 9), (4, list(range(300)))]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    for width in (2, 4):
        manifest = order.write_shards(df, f"file://{tmp_path}/{width}", "ids", length=8, shard_sequences=16, width=width)
        by = {}
        for r in order.read_shards(manifest).collect():
            by.setdefault(r.doc_id, {})[r.place] = np.frombuffer(r.tokens, f"<u{width}").tolist()
        assert {k: sum((v[i] for i in sorted(v)), []) for k, v in by.items()} == {k: ids or [] for k, ids in rows}
        first = manifest.orderBy("shard").first()
        with open(first.path.removeprefix("file://"), "rb") as f:
            assert struct.unpack(order.HEADER, f.read(64))[2:4] == (8, width) and first.bytes == 64 + first.sequences * (16 + 8 * width)
    with pytest.raises(Exception, match="does not fit 2 bytes"):
        order.write_shards(spark.createDataFrame([(1, [65_536])], df.schema), f"file://{tmp_path}/large", "ids", width=2)


def test_shards_of_other_inputs_or_keys_are_replaced(spark, tmp_path):
    out = f"file://{tmp_path}/same"
    write = lambda letter, seed: order.write_shards(spark.createDataFrame([(i, letter * 20) for i in range(40)], SCHEMA), out, length=8, shard_sequences=32, seed=seed)
    read = lambda m: {r.slot: (r.doc_id, r.place, bytes(r.tokens)[:1]) for r in order.read_shards(m).collect()}
    a, b, c = read(write("a", 1)), read(write("b", 1)), read(write("b", 2))
    assert {x[2] for x in a.values()} == {b"a"} and {x[2] for x in b.values()} == {b"b"}
    assert b != c and sorted(b.values()) == sorted(c.values())


def scalar_feistel(x, n, key):
    """The permutation once more, number by number."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, full = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(4):
            f = ((right ^ ((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & full)) * 0xBF58476D1CE4E5B9) & full
            f ^= f >> 29
            f = (f * 0x94D049BB133111EB) & full
            left, right = right, left ^ ((f ^ (f >> 32)) & mask)
        x = (left << half) | right
        if x < n:
            return x


@pytest.mark.parametrize("broadcast", [order.BROADCAST_ROWS, 0])
def test_training_order_against_brute_force(spark, monkeypatch, broadcast):
    from pyspark.sql import functions as F

    monkeypatch.setattr(order, "BROADCAST_ROWS", broadcast)
    rows = [(i, list(range(i, i + 3 * (i % 9)))) for i in range(60)] + [(None, [1] * 20), (3, [9]), (3, [9]), (70, None), (71, [])]
    df = spark.createDataFrame([(k, x, "e", 1, 2) for k, x in rows], "doc_id bigint, ids array<int>, doc string, hash int, shard int")
    made = df.select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.xxhash64(F.lit("again"), "ids").alias("h2")).withColumn("b", F.pmod(F.xxhash64("doc_id", "h"), F.lit(1024))).distinct().collect()
    made.sort(key=lambda r: (r.b, r.doc_id is not None, r.doc_id or 0, r.h, r.h2))
    sequences = [(r.doc_id, place, (r.ids or [])[place * 8:place * 8 + 8]) for r in made for place in range(max(1, -(-len(r.ids or []) // 8)))]
    want = set()
    for number, (doc, place, ids) in enumerate(sequences):
        slot = scalar_feistel(number, len(sequences), 5)
        want.add((slot, slot // 16, 64 + slot % 16 * (16 + 8 * 2), doc, place, len(ids), zlib.crc32(np.array(ids, "<u2").tobytes())))
    got = order.training_order(spark, df, "ids", length=8, shard_sequences=16, seed=5, width=2).collect()
    assert len(got) == len(want) and {(r.slot, r.shard, r.offset, r.doc_id, r.place, r.n_tokens, r.tokens_crc32) for r in got} == want


def test_equal_hashes_of_one_document_lose_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(order, "_hashes", lambda text: (F.lit(1).cast("bigint").alias("hash"), F.xxhash64(text).alias("hash2")))
    df = spark.createDataFrame([(1, "abc"), (1, "xyz"), (1, "abc")], SCHEMA)
    assert sorted(r.tokens_crc32 for r in order.training_order(spark, df, length=4).collect()) == sorted(zlib.crc32(x) for x in (b"abc", b"xyz"))

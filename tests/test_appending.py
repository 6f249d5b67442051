"""Chains, receipts and Merkle trees batch by batch against all at once."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import integrity

ROWS = "k string, s bigint, p string"


def fold(rows):
    out = {}
    for key in {k for k, _, _ in rows}:
        last = "0" * 64
        for place, (_, s, p) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] or ""))):
            now = hashlib.sha256((last + (p or "")).encode()).hexdigest()
            out[key, s, place] = last, now
            last = now
    return out


def root(leaves):
    while len(leaves) > 1:
        leaves = [hashlib.sha256(bytes.fromhex("".join(leaves[i : i + 2]))).hexdigest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def test_chains_go_on_from_their_heads(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice(["x", "", None, "é"])) for i in range(60)] + [("late", 59, "y")]
    heads, got = None, {}
    for low, high in ((0, 20), (20, 20), (20, 21), (21, 60)):
        new = spark.createDataFrame([r for r in rows if low <= r[1] < high], ROWS)
        linked = integrity.append_chain(new, heads, "k", "s", "p").checkpoint() if low == 0 else integrity.append_chain(new, heads, "k", "s", "p")
        got |= {(r.k, r.s, r.place): (r.prev_hash, r.entry_hash) for r in linked.collect()}
        heads = integrity.chain_heads(linked, heads, "k", "s")
    assert got == fold(rows)
    assert {(r.k, r.s, r.place, r.entry_hash) for r in heads.collect()} == {max(((k, s, n, h) for (k, s, n), (_, h) in got.items() if k == key), key=lambda r: r[2]) for key in ("a", "b", None, "late")}


def test_repeated_places_in_one_batch_keep_one_head(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y")]
    linked = integrity.append_chain(spark.createDataFrame(rows, ROWS), None, "k", "s", "p")
    head = integrity.chain_heads(linked, None, "k", "s").first()
    assert (head.place, head.entry_hash) == (2, max(fold(rows).items(), key=lambda e: e[0][2])[1][1])


@pytest.mark.parametrize("seq", [4, 5, None])
def test_nothing_is_put_before_a_head(spark, seq):
    head = spark.createDataFrame([("a", 5, 0, "f" * 64)], "k string, s bigint, place bigint, entry_hash string")
    with pytest.raises(Exception, match="not after its head"):
        integrity.append_chain(spark.createDataFrame([("a", seq, "x")], ROWS), head, "k", "s", "p").collect()


def test_trees_grow_by_their_frontiers(spark):
    sizes = {"one": [1, 0, 0, 0], "two": [0, 2, 1, 5], "odd": [3, 4, 0, 6], "big": [13, 3, 16, 1], "late": [0, 0, 0, 7], "still": [6, 0, 0, 0]}
    frontier, have = None, {t: [] for t in sizes}
    for batch in range(4):
        rows = [(t, i, hashlib.sha256(f"{t}{batch}{i}".encode()).hexdigest()) for t, n in sizes.items() for i in range(n[batch])]
        for t, _, h in rows:
            have[t].append(h)
        random.Random(batch).shuffle(rows)
        leaves = spark.createDataFrame(rows + [(None, 0, "f" * 64)], "t string, i bigint, h string")
        frontier = integrity.append_merkle(leaves, frontier, "t", "i", "h")
        assert {r.t: r.root for r in integrity.frontier_roots(frontier, "t").collect()} == {t: root(h) for t, h in have.items() if h}
        kept = {r.t: (r.n, r.leaves) for r in frontier.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.expr("shiftleft(1L, level)")).alias("leaves")).collect()}
        assert kept == {t: (len(h).bit_count(), len(h)) for t, h in have.items() if h}
    again = integrity.append_merkle(spark.createDataFrame([], "t string, i bigint, h string"), frontier, "t", "i", "h")
    assert sorted(again.collect()) == sorted(frontier.collect())
    assert integrity.append_merkle(spark.createDataFrame([], "t string, i bigint, h string"), None, "t", "i", "h").collect() == []

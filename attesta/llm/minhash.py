"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct shingles of five words (A-Z lower-cased, parted by ASCII white
space). Coordinate k of the signature is the least p((s(x) + k) mod 2^32) over the shingles x: one
permutation s spreads the shingles over a circle, one permutation p is read with a circular shift
of k, so two permutations make all 128 coordinates. Bands of 4 give buckets.

Documents with equal sets form a class that its smallest id stands for. Candidates in a bucket are
never expanded into all pairs. First each member is paired with the bucket's least id, and the
pairs are verified on full sets. Buckets that still hold several components then give a spanning
forest of the pairs whose estimate is not far below the threshold (0.60 of the coordinates for
0.75: four standard deviations); it only says which components may belong together. Each such
cluster gets the full sets of its documents once, and all pairs between its components are decided
exactly by matrix products; only links come out. Large buckets and clusters are compared block by
block in separate groups, and the pairs inside a bucket's or cluster's largest component are left out.

Losses: banding loses a pair of similarity 0.75 with odds of 5e-6, the estimate within a bucket with
odds of 8e-5 unless another path joins the two; more similar pairs are lost less often.

Shingles are told by 64-bit hashes that depend on a secret number drawn for each call, so two unlike
shingles of a pair of documents are taken for one with odds of about 1e-19 whatever the texts are. With fewer than five words the whole sequence is the one
shingle; without words or text the set is empty and linked with nothing. Rows that repeat a doc_id
are one document with several texts. A null doc_id links nothing but shares its class's component.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrays import lean, lean_group, lower_ascii, mix64, steps, text_bytes
from attesta.llm.graph import components
from attesta.session import materialize

WORDS = 5
ROWS, BANDS = 4, 32
COORDINATES = ROWS * BANDS
#: Documents, and shingles, of one block of a large group.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Candidate ids of up to this many rows are broadcast (16 MB of ids at most); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_BASE = 0x9E3779B97F4A7C15


def word_hashes(b: np.ndarray, blank: np.ndarray, starts: np.ndarray, stops: np.ndarray, secret: int) -> np.ndarray:
    """A hash of each word: the sum of what a secret number makes of each byte and its place in the word, so that nobody can write texts whose words collide."""
    size = stops - starts
    first = np.cumsum(size) - size
    place = np.arange(size.sum(), dtype=np.uint64) - np.repeat(first, size).astype(np.uint64)
    spread = mix64((place << np.uint64(8) | b[~blank]) + np.uint64(secret))
    return mix64((np.add.reduceat(spread, first) if len(first) else np.zeros(0, np.uint64)) + size.astype(np.uint64))


def shingle_sets(texts: pa.Array, secret: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and n + 1 offsets."""
    raw, at = text_bytes(texts)
    b = lower_ascii(raw)
    blank = (b == 32) | ((b - np.uint8(9)) < 5)
    start = ~blank
    inner = np.zeros(len(b) + 1, bool)
    inner[at[:-1]] = True  # words end with their text
    start[1:] &= blank[:-1] | inner[1:-1]
    starts = np.flatnonzero(start)
    stop = ~blank
    stop[:-1] &= blank[1:] | inner[1:-1]
    stops = np.flatnonzero(stop) + 1
    word = word_hashes(b, blank, starts, stops, secret)
    first = np.searchsorted(starts, at)  # words before each text
    counts = np.diff(first)
    rolled = word.copy()
    for k in range(1, min(words, len(word))):
        rolled[: len(word) - k] = rolled[: len(word) - k] * np.uint64(_BASE) + word[k:]
    rolled = mix64(rolled)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts.tolist()):
        if n == 0:
            continue
        if n < words:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in word[first[i]:first[i + 1]]:
                    h = h * np.uint64(_BASE) + w
            own = mix64(np.array([h ^ np.uint64(0x5851F42D4C957F2D)]))
        else:
            own = np.sort(rolled[first[i]:first[i + 1] - words + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, offsets: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash signatures (uint32) of nonempty sets."""
    spread = (flat >> np.uint64(32)).astype(np.uint32)  # the first permutation is the hash's own mixing
    out = np.empty((len(offsets) - 1, coordinates), np.uint32)
    h, t = np.empty_like(spread), np.empty_like(spread)
    begin = offsets[:-1]
    for k in range(coordinates):
        np.add(spread, np.uint32(k), out=h)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
            np.right_shift(h, np.uint32(shift), out=t)
            np.bitwise_xor(h, t, out=h)
            if factor:
                np.multiply(h, np.uint32(factor), out=h)
        out[:, k] = np.minimum.reduceat(h, begin)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each document and band."""
    halves = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS // 2)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(sig), 1), np.uint64)
    for i in range(ROWS // 2):
        h = mix64(h * np.uint64(_BASE) + halves[:, :, i])
    return h.view(np.int64)


def document_signatures(docs: DataFrame, secret: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, set_key (16 bytes of the whole set), bands and sig; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "_text", 1 << 20):
                flat, offsets = shingle_sets(part["_text"], secret)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                sig = signatures(flat, np.append(offsets[full], offsets[-1])) if len(full) else np.zeros((0, COORDINATES), np.uint32)
                bands, keys, names, sigs = band_keys(sig).tolist() if len(full) else [], [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
                for j, i in enumerate(full.tolist()):
                    keys[i], sigs[i] = bands[j], sig[j].tobytes()
                    names[i] = hashlib.blake2b(flat[offsets[i]:offsets[i + 1]].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([part["_key"], pa.array(sizes), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["_key", "n_shingles", "set_key", "bands", "sig"])

    return docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).mapInArrow(lean(run), "_key bigint, n_shingles bigint, set_key binary, bands array<bigint>, sig binary").withColumnRenamed("_key", key)


def document_sets(docs: DataFrame, secret: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the full set as array<bigint>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "_text", 1 << 20):
                flat, offsets = shingle_sets(part["_text"], secret)
                yield pa.RecordBatch.from_arrays([part["_key"], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))], ["_key", "set"])

    return docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).mapInArrow(lean(run), "_key bigint, set array<bigint>").withColumnRenamed("_key", key)


def _near_size(a: Column, b: Column) -> Column:
    """What sizes must hold for a Jaccard similarity of 0.75."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * 75


def _spanning(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> list[int]:
    """Places of the edges of a maximum spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for e in np.argsort(-score, kind="stable").tolist():
        x, y = find(int(a[e])), find(int(b[e]))
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(e)
    return kept


def _forest(sig: np.ndarray, comp: np.ndarray, n: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components with members whose estimate is at least `least`, as a spanning forest. side: 0 and 1 mark two blocks, 2 one."""
    a, b, score = [], [], []
    need = int(np.ceil(least * sig.shape[1]))
    for i in range(len(comp)):
        others = np.arange(i + 1, len(comp))
        others = others[(comp[others] != comp[i]) & ((side[others] != side[i]) | (side[i] == 2)) & (np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * 75)]
        if len(others):
            same = (sig[others] == sig[i]).sum(1)
            good = same >= need
            a.append(np.full(good.sum(), comp[i]))
            b.append(comp[others[good]])
            score.append(same[good])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, score = np.concatenate(a), np.concatenate(b), np.concatenate(score)
    kept = _spanning(a, b, score)
    return a[kept], b[kept]


def _linked(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, slab: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components with members of Jaccard similarity 0.75 or more, as a spanning forest. Intersections are counted by matrix products over slabs of shingles that several sets hold."""
    sizes = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    several = counts[place] > 1
    row, col = row[several], column[place[several]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left = np.flatnonzero(side != 1)
    right = left if (side == 2).all() else np.flatnonzero(side == 1)
    shared = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int((counts > 1).sum()), slab):
        i, j = np.searchsorted(col, [c, c + slab])
        held = np.zeros((len(sets), slab), np.float32)
        held[row[i:j], col[i:j] - c] = 1
        shared += held[left] @ held[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    good = (100 * shared >= 75 * union) & (comp[left][:, None] != comp[right][None, :])
    x, y = np.nonzero(good)
    pairs = np.unique(np.stack([np.minimum(comp[left[x]], comp[right[y]]), np.maximum(comp[left[x]], comp[right[y]])], 1), axis=0)
    kept = _spanning(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs)))
    return pairs[kept, 0], pairs[kept, 1]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _dealt(members: DataFrame, group: str, whole: int = 0) -> DataFrame:
    """members (group, comp, id, n and more) with kind, i, j and side: the groups in which they meet the members of other components.

    Members outside the group's largest component are dealt to blocks, those inside to others, of about BLOCK members and
    BLOCK_SHINGLES shingles each; pairs of outer blocks, and of an outer with an inner one, are groups of their own, and
    pairs inside the largest component are left out. So a group of m members with few strays sends about m rows for each
    block of strays. Groups of at most `whole` members stay in one piece. side: 0 and 1 mark two blocks, 2 one.
    """
    by_comp = members.groupBy(group, "comp").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    by_group = by_comp.groupBy(group).agg(F.max_by(F.struct("comp", "size", "weight"), F.struct("size", "comp")).alias("large"), F.sum("size").alias("all"), F.sum("weight").alias("weight"))
    blocks = lambda size, weight: F.greatest(F.ceil(size / BLOCK), F.ceil(weight / BLOCK_SHINGLES)).cast("int")
    figures = by_group.select(group, F.col("large.comp").alias("_large"), F.col("all").alias("_all"), blocks(F.col("large.size"), F.col("large.weight")).alias("_ni"), blocks(F.col("all") - F.col("large.size"), F.col("weight") - F.col("large.weight")).alias("_no"))
    dealt = members.join(figures, group).withColumn("_inner", F.col("comp") == F.col("_large"))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.when(F.col("_inner"), F.col("_ni")).otherwise(F.col("_no")))).cast("int"))
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    own, none = F.col("_own"), F.array().cast("array<struct<kind:string,i:int,j:int,side:int>>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    with_inner = F.transform(upto(F.col("_ni")), lambda j: place("inner", own, j, F.lit(0)))
    with_outer = F.transform(upto(F.col("_no")), lambda j: place("outer", F.least(own, j), F.greatest(own, j), F.when(own == j, 2).when(own < j, 0).otherwise(1)))
    as_inner = F.transform(upto(F.col("_no")), lambda i: place("inner", i, own, F.lit(1)))
    places = F.when(F.col("_all") <= whole, F.array(place("whole", F.lit(0), F.lit(0), F.lit(2)))).when(F.col("_inner"), as_inner).otherwise(F.concat(with_inner, with_outer))
    return dealt.withColumn("_p", F.explode(F.coalesce(places, none))).select(*members.columns, "_p.kind", "_p.i", "_p.j", "_p.side")


def _near_components(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of components that may belong together. members: bucket, id, comp, n, sig of buckets with several components."""

    def run(t: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
        a, b = _forest(sig, *(t[c].to_numpy() for c in ("comp", "n", "side")), least)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=_PAIR)

    dealt = _dealt(members.select("bucket", "id", "comp", "n", "sig"), "bucket", BLOCK).select("bucket", "kind", "i", "j", "side", "comp", "n", "sig")
    return dealt.groupBy("bucket", "kind", "i", "j").applyInArrow(lean_group(run), "a bigint, b bigint").distinct()


def _cluster_links(clustered: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components, decided on full sets. clustered: cluster, comp, id, n."""

    def run(t: pa.Table) -> pa.Table:
        lists = t["set"].combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        side = t["side"].to_numpy()
        if len(np.unique(side)) < 2 and side[0] != 2:  # one block without its partner
            return pa.table({"a": [], "b": []}, schema=_PAIR)
        a, b = _linked([values[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)], t["comp"].to_numpy(), side)
        return pa.table({"a": a, "b": b}, schema=_PAIR)

    dealt = _dealt(clustered.select("cluster", "comp", "id", "n"), "cluster").select("cluster", "kind", "i", "j", "side", "comp", "id")
    return dealt.join(sets.withColumnRenamed("doc_id", "id"), "id").drop("id").groupBy("cluster", "kind", "i", "j").applyInArrow(lean_group(run), "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("_sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("_sb"))
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("_sa", "_sb"))
    return both.withColumn("_n", shared).where(F.col("_n") * 100 >= (F.size("_sa") + F.size("_sb") - F.col("_n")) * 75).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.60, secret: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs. secret: of 63 bits, what hashes of words depend on; drawn for each call if not given."""
    secret = secrets.randbits(63) if secret is None else secret
    spark = docs.sparkSession
    named = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(document_signatures(named, secret), "minhash-signatures")
    classes = materialize(signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "minhash-classes")

    placed = classes.select(F.explode("bands").alias("bucket"), "id", "n")
    shared = placed.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1").select("bucket", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    members = materialize(placed.join(shared, "bucket"), "minhash-buckets")
    pairs = materialize(members.where((F.col("id") != F.col("hub")) & _near_size(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "minhash-pairs")

    ids = materialize(members.select("id").distinct(), "minhash-ids")
    few = ids.count()
    if few == 0:
        found = None
    else:
        wanted = F.broadcast(ids) if few <= BROADCAST_ROWS else ids
        sets = materialize(document_sets(named.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), secret).dropDuplicates(["doc_id", "set"]), "minhash-sets")
        links = materialize(_verified(pairs, sets), "minhash-links")
        found = components(links, "a", "b")
        # buckets that still hold several components
        comp = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("comp"))
        open_ = comp.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        asked = materialize(comp.join(open_, "bucket"), "minhash-open")
        near = materialize(_near_components(asked.join(classes.select("id", "sig"), "id"), least), "minhash-near")
        if not near.isEmpty():
            clusters = components(near, "a", "b").select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
            added = materialize(_cluster_links(asked.select("id", "comp", "n").distinct().join(clusters, "comp"), sets), "minhash-links")
            if not added.isEmpty():
                found = components(links.unionByName(added), "a", "b")

    of_class = classes.select("set_key", "id")
    if found is not None:
        of_class = of_class.join(found.withColumnRenamed("node", "id"), "id", "left").select("set_key", F.coalesce("component", "id").alias("id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    # a document without a set stands alone
    return out.select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; same columns. Rows with a null id stay."""
    name = "_gone"
    while name in docs.columns:
        name += "_"
    gone = near_duplicates(docs, text, key).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[key] == gone[name], "left_anti")

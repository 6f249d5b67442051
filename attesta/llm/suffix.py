"""Suffix-array deduplication: cut every byte that lies in a 50-byte string of an earlier document.

Work is dealt by content, so shards need no comparing of all with all. The anchor of a 50-byte
string is the 24-byte string in it with the least hash; equal strings have equal anchors. Neighbouring
strings with one anchor form a run, at most 76 bytes of text.

1. Blocks of documents list their anchors; anchors met in two documents or more are shared.
2. Blocks send the runs of shared anchors to the shard of the anchor. Equal runs of one block are
   combined first: only those of the smallest document travel, so a passage that a third of all
   documents share comes to a shard once a block, and the shard combines those again. Hashes bring
   runs side by side, their bytes decide whether they are equal.
3. A shard sorts the suffixes of its runs by prefix doubling (Larsson-Sadakane refinement: only
   groups that are still tied are sorted again), takes the common prefixes of neighbours by
   Kasai's method, and so has all equal 50-byte strings side by side with their smallest
   document. A shard too large for one array is sorted in parts, whose distinct strings are
   merged by binary search.
4. Blocks cut the spans that the shards report.

The text crosses the network once (the three uses of the exchange by block share it). Matches
never cross documents; rows with one doc_id are one document and don't cut each other. A null
doc_id is neither earlier nor later than any: such rows are kept whole. Null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrays import lean_cogroup, lean_group, mix64, text_bytes

LENGTH = 50
#: Long enough that unlike texts seldom share one by chance; the longer, the more anchors.
ANCHOR = 24
BLOCK_BYTES = 2 << 20
#: Bytes of runs that one suffix array takes: positions must fit 21 bits.
PART_BYTES = (1 << 21) - 1
#: Bytes that are hashed at a time.
_SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse, for at most a slice and a string."""
    if not _POWERS:
        _POWERS[:] = [np.cumprod(np.full(_SLICE + 4 * LENGTH, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _sums(b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(len(b))[0], out=out[1:])
    return out


def _run_hashes(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of a text of runs (at most 76 bytes each), a slice at a time."""
    stop = np.cumsum(size)
    out, a = np.zeros(len(size), np.uint64), 0
    while a < len(size):
        begin = stop[a] - size[a]
        z = max(a + 1, int(np.searchsorted(stop, begin + _SLICE, side="right")))
        at, end = stop[a:z] - size[a:z] - begin, stop[a:z] - begin
        sums = _sums(text[begin:begin + end[-1]])
        out[a:z] = mix64((sums[end] - sums[at]) * _powers(int(end[-1]))[1][at] + size[a:z].astype(np.uint64))
        a = z
    return out


def part_unlike(text: np.ndarray, at: np.ndarray, size: np.ndarray, order: np.ndarray, new: np.ndarray, slab: int = 1 << 13) -> None:
    """Mark in `new` (which of the ordered runs begin a group, as their hashes and sizes tell) those too whose bytes differ from the run before."""
    pairs = np.flatnonzero(~new)
    for s in range(0, len(pairs), slab):
        i = pairs[s:s + slab]
        x, y = order[i], order[i - 1]
        n = size[x]
        differ = text[_ragged(at[x], n)] != text[_ragged(at[y], n)]
        new[i] = np.logical_or.reduceat(differ, np.cumsum(n) - n)


def gram_runs(b: np.ndarray, offsets: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first and last start of each run of 50-byte strings with one anchor, the anchor's hash and a hash of the run's bytes."""
    begins, ends = offsets[:-1][usable], offsets[1:][usable] - LENGTH + 1
    fits = ends > begins
    edge = np.zeros(len(b) + 1, np.int8)
    np.add.at(edge, begins[fits], 1)
    np.add.at(edge, ends[fits], -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    parts: list[list[np.ndarray]] = [[], [], [], []]
    width = LENGTH - ANCHOR + 1
    for s in range(0, len(b), _SLICE):
        starts = np.flatnonzero(valid[s:s + _SLICE])
        if not len(starts):
            continue
        seg = b[s:s + _SLICE + LENGTH - 1]
        sums, (_, inverse) = _sums(seg), _powers(len(seg))
        h = mix64((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(seg) - ANCHOR + 1])
        # the least hash and, among equal ones, the leftmost place
        key = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
        done = 1
        while done < width:
            step = min(done, width - done)
            key = np.minimum(key[:-step], key[step:])
            done += step
        anchor = (key[starts] & np.uint64((1 << 21) - 1)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1])
        at = np.flatnonzero(new)
        first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
        own = mix64((sums[last + LENGTH] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
        for out, x in zip(parts, (first + s, last + s, h[anchor[at]], own), strict=True):
            out.append(x)
    if not parts[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in parts)


def suffix_array(text: np.ndarray, left: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions of text in the order of their next `depth` bytes. left: bytes up to the end of the string a position is in; nothing beyond counts.

    Ranks by 5 bytes come from one sort; each refinement sorts tied positions by the rank h bytes on, until h is depth.
    """
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    packed = np.zeros(n, np.uint64)
    for k in range(5):
        packed <<= np.uint64(8)
        packed |= np.where(left > k, wide[k:k + n], np.uint8(0))
    place = np.uint64((1 << 21) - 1)
    packed <<= np.uint64(21)
    packed |= np.arange(n, dtype=np.uint32)
    packed.sort()
    sa = (packed & place).astype(np.int32)
    packed >>= np.uint64(21)
    head = np.ones(n, bool)
    head[1:] = packed[1:] != packed[:-1]
    del packed
    rank = np.empty(n, np.uint32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.uint32), np.uint32(0))) + np.uint32(1)
    h = 5
    while h < depth:
        step = min(h, depth - h)
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = sa[slots]
        on = at + step
        further = np.where(left[at] > step, rank[np.minimum(on, n - 1)], 0).astype(np.uint64)
        # ties stay in the slots of their group, as the group's rank leads
        packed = np.sort((rank[at].astype(np.uint64) << np.uint64(42)) | (further << np.uint64(21)) | at.astype(np.uint64))
        sa[slots] = (packed & place).astype(np.int32)
        new = np.ones(len(slots), bool)
        new[1:] = (packed[1:] >> np.uint64(21)) != (packed[:-1] >> np.uint64(21))
        head[slots] = new
        rank[sa[slots]] = (np.maximum.accumulate(np.where(new, slots, 0)) + 1).astype(np.uint32)
        h += step
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, first: np.ndarray, counts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each position of sa, bytes (at most depth) it shares with the one before it.

    Kasai's method over all runs at once: in text order a position shares at least one byte less
    than the one before it did, unless its neighbour's run ends. first and counts: the runs' positions in sa's domain.
    """
    before = np.full(len(text), -1, np.int32)
    before[sa[1:]] = sa[:-1]
    member = np.zeros(len(text) + 1, bool)
    member[sa] = True
    shared = np.zeros(len(text), np.uint8)  # depth is below 256
    wide = np.concatenate([text, np.zeros(depth, np.uint8)])
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    h = np.zeros(len(first), np.int64)
    known = np.zeros(len(first), bool)  # whether the neighbour of the position before shows a lower bound
    for k in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -k, side="left"))
        i = first[:live] + k
        j = before[i]
        h = np.where(known[:live], np.maximum(h[:live] - 1, 0), 0)
        go = np.flatnonzero(j >= 0)
        h[j < 0] = 0
        while len(go):
            go = go[h[go] < depth]
            go = go[wide[i[go] + h[go]] == wide[j[go] + h[go]]]
            h[go] += 1
        shared[i] = h
        # beyond `depth` equal bytes the order is open, and the bound needs the very same pair of runs
        known = (j >= 0) & member[j + 1] & ((h < depth) | (before[np.minimum(i + 1, len(text) - 1)] == j + 1))
    return shared[sa]


def smallest_documents(grams: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The smallest document of each string over all parts. grams: of each part its sorted distinct strings (bytes) and their smallest documents."""
    out = [docs.copy() for _, docs in grams]
    for i, (mine, _) in enumerate(grams):
        for k, (other, docs) in enumerate(grams):
            if i != k and len(mine) and len(other):
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                same = other[at] == mine
                out[i][same] = np.minimum(out[i][same], docs[at[same]])
    return out


def repeated_starts(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray, part_bytes: int = PART_BYTES) -> np.ndarray:
    """Whether each start of a 50-byte string (runs in order, sizes - 49 starts each) is of a string that a smaller document also has."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    cuts, at = [0], 0
    while at < len(sizes):
        at = max(at + 1, int(np.searchsorted(offsets, offsets[at] + part_bytes, side="right")) - 1)
        cuts.append(at)
    parts, grams = [], []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        t, n = text[offsets[a]:offsets[z]], sizes[a:z]
        begin = offsets[a:z] - offsets[a]
        left = np.repeat((begin + n).astype(np.int32), n) - np.arange(len(t), dtype=np.int32)
        sa = suffix_array(t, left)
        sa = sa[left[sa] >= LENGTH]
        shared = common_prefixes(t, sa, begin, n - LENGTH + 1)
        head = shared < LENGTH
        head[:1] = True
        at_head = np.flatnonzero(head)
        own = np.repeat(np.arange(a, z, dtype=np.int32), n)[sa]
        least = np.minimum.reduceat(docs[own], at_head) if len(own) else np.zeros(0, docs.dtype)
        parts.append((len(t), sa, np.cumsum(head, dtype=np.int32) - 1, own, least, left))
        if len(cuts) > 2:
            window = np.lib.stride_tricks.sliding_window_view(t, LENGTH)[sa[at_head]]
            strings = np.concatenate([window, np.ones((len(window), 1), np.uint8)], 1)  # the last byte keeps trailing zeros
            grams.append((np.ascontiguousarray(strings).view(f"S{LENGTH + 1}").ravel(), least))
    merged = smallest_documents(grams) if grams else [p[4] for p in parts]
    out = []
    for (n, sa, group, own, _, left), least in zip(parts, merged, strict=True):
        flag = np.zeros(n, bool)
        flag[sa] = least[group] < docs[own]
        out.append(flag[left >= LENGTH])
    return np.concatenate(out) if out else np.zeros(0, bool)


def _block(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in an order that their content gives; its bytes, offsets, ids and whether a row takes part."""
    ids, texts = t["_id"].to_pylist(), t["_text"]
    if len(set(ids)) < len(ids):
        words = texts.to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, words[i] or ""))
    else:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    t = t.take(pa.array(order, pa.int64()))
    b, offsets = text_bytes(t["_text"].combine_chunks())
    usable = np.array([ids[i] is not None for i in order], bool)
    return t, b, offsets, np.array([ids[i] or 0 for i in order], np.int64), usable


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    at = np.flatnonzero(np.diff(buckets[order], prepend=-1))
    for a, z in zip(at, np.append(at[1:], len(order)), strict=True):
        yield int(buckets[order[a]]), order[a:z]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each piece, one piece after another."""
    done = np.cumsum(sizes)
    return np.repeat(starts - done + sizes, sizes) + np.arange(done[-1] if len(done) else 0)


_LIST = "b int, block int, hashes binary"
_SHARED = "block int, b int, hashes binary"
_RUNS = "b int, block int, starts binary, sizes binary, docs binary, bytes binary"
_SPANS = "block int, starts binary, ends binary"


def _pack(keys: np.ndarray) -> bytes:
    """Keys of 40 bits, 5 bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _shard_and_key(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of an anchor, and 39 of its hash's upper bits. Unlike anchors that share both only send runs in vain."""
    return (hashes >> np.uint64(1)) % np.uint64(shards), hashes >> np.uint64(25)


def _list_anchors(shards: int):
    def run(t: pa.Table) -> pa.Table:
        block = t["_block"][0].as_py()
        _, b, offsets, ids, usable = _block(t)
        first, _, hashes, _ = gram_runs(b, offsets, usable)
        doc = ids[np.searchsorted(offsets, first, side="right") - 1]
        order = np.lexsort((doc, hashes))
        h, d = hashes[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        many = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at) if len(at) else np.zeros(0, bool)
        shard, key = _shard_and_key(h[at], shards)
        sent = (key << np.uint64(1)) | many.astype(np.uint64)
        rows = list(_by_bucket(shard.astype(np.int64)))
        return pa.table({"b": pa.array([k for k, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "hashes": pa.array([_pack(sent[i]) for _, i in rows], pa.binary())})

    return run


def _shared_anchors(t: pa.Table) -> pa.Table:
    parts = [_unpack(x) for x in t["hashes"].to_pylist()]
    h = np.concatenate(parts)
    block = np.repeat(t["block"].to_numpy(), [len(x) for x in parts])
    order = np.argsort(h >> np.uint64(1))
    h, block = h[order], block[order]
    k = h >> np.uint64(1)
    again = (h & np.uint64(1)) == 1  # in several documents of its block
    if len(k) > 1:
        pair = k[1:] == k[:-1]
        again[1:] |= pair
        again[:-1] |= pair
    k, block = k[again], block[again]
    rows = list(_by_bucket(block.astype(np.int64)))
    return pa.table({"block": pa.array([x for x, _ in rows], pa.int32()), "b": pa.array([t["b"][0].as_py()] * len(rows), pa.int32()), "hashes": pa.array([_pack(k[i]) for _, i in rows], pa.binary())})


def _send_runs(shards: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        empty = pa.table({"b": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("starts", "sizes", "docs", "bytes")}})
        if not docs.num_rows or not shared.num_rows:
            return empty
        block = docs["_block"][0].as_py()
        known = np.sort(np.concatenate([_unpack(x) | (np.uint64(s) << np.uint64(39)) for s, x in zip(shared["b"].to_pylist(), shared["hashes"].to_pylist(), strict=True)]))
        _, b, offsets, ids, usable = _block(docs)
        if len(b) >= 1 << 32:
            raise ValueError("a block must hold fewer than 4 GiB of text")
        first, last, hashes, own = gram_runs(b, offsets, usable)
        shard, key = _shard_and_key(hashes, shards)
        k = key | (shard << np.uint64(39))
        hit = known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k
        first, last, k, own = first[hit], last[hit], k[hit], own[hit]
        doc = ids[np.searchsorted(offsets, first, side="right") - 1]
        # equal runs of the block: those of the smallest document travel, the others are repeats already
        order = np.lexsort((doc, own, k))
        length = last - first + LENGTH
        new = np.ones(len(order), bool)
        new[1:] = (k[order][1:] != k[order][:-1]) | (own[order][1:] != own[order][:-1]) | (length[order][1:] != length[order][:-1])
        part_unlike(b, first, length, order, new)
        least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        repeat = np.zeros(len(order), bool)
        repeat[order] = doc[order] > least
        rows = [(-1 - block, np.flatnonzero(repeat))] if repeat.any() else []
        go = np.flatnonzero(~repeat)
        rows += [(x, go[i]) for x, i in _by_bucket((k[go] >> np.uint64(39)).astype(np.int64))]
        if not rows:
            return empty
        sizes = (last - first + LENGTH).astype(np.uint8)  # at most 76
        text = [b"" if x < 0 else b[_ragged(first[i], sizes[i].astype(np.int64))].tobytes() for x, i in rows]
        return pa.table({
            "b": pa.array([x for x, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "starts": pa.array([first[i].astype(np.uint32).tobytes() for _, i in rows], pa.binary()),
            "sizes": pa.array([sizes[i].tobytes() for _, i in rows], pa.binary()), "docs": pa.array([doc[i].tobytes() for _, i in rows], pa.binary()), "bytes": pa.array(text, pa.binary()),
        })

    return run


def _find_repeats(t: pa.Table) -> pa.Table:
    starts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in t["starts"].to_pylist()]
    sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in t["sizes"].to_pylist()]
    block = np.repeat(t["block"].to_numpy(), [len(x) for x in starts])
    first, size = np.concatenate(starts), np.concatenate(sizes)
    if t["b"][0].as_py() < 0:
        begin, end = first, first + size
    else:
        text = np.frombuffer(b"".join(t["bytes"].to_pylist()), np.uint8)
        docs = np.frombuffer(b"".join(t["docs"].to_pylist()), np.int64)
        # equal runs are sorted once, as the smallest document's
        at, own = np.cumsum(size) - size, _run_hashes(text, size)
        order = np.lexsort((docs, size, own))
        new = np.ones(len(order), bool)
        new[1:] = (own[order][1:] != own[order][:-1]) | (size[order][1:] != size[order][:-1])
        part_unlike(text, at, size, order, new)
        heads = order[new]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        flag = repeated_starts(text[_ragged(at[heads], size[heads])], size[heads], docs[heads])
        counts = size[heads] - LENGTH + 1
        place, of = _ragged(np.zeros(len(heads), np.int64), counts)[flag], np.repeat(np.arange(len(heads)), counts)[flag]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (of[1:] != of[:-1])
        k = np.flatnonzero(new)
        head_begin = place[k]
        head_end = place[np.append(k[1:], len(place)) - 1] + LENGTH if len(k) else place
        spans = np.bincount(of[k], minlength=len(heads))
        # a larger document's equal run goes whole, the smallest one's own copies as their head
        later = docs > docs[heads][group]
        same = np.flatnonzero(~later)
        each = spans[group[same]]
        take = _ragged((np.cumsum(spans) - spans)[group[same]], each)
        base = np.repeat(first[same], each)
        begin = np.concatenate([first[later], base + head_begin[take]])
        end = np.concatenate([(first + size)[later], base + head_end[take]])
        block = np.concatenate([block[later], np.repeat(block[same], each)])
    rows = list(_by_bucket(block.astype(np.int64)))
    return pa.table({"block": pa.array([x for x, _ in rows], pa.int32()), "starts": pa.array([begin[i].tobytes() for _, i in rows], pa.binary()), "ends": pa.array([end[i].tobytes() for _, i in rows], pa.binary())})


def _cut(names: list[str]):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        t, b, offsets, _, _ = _block(docs)
        gone = np.zeros(len(b) + 1, np.int32)
        if spans.num_rows:
            np.add.at(gone, np.frombuffer(b"".join(spans["starts"].to_pylist()), np.int64), 1)
            np.add.at(gone, np.frombuffer(b"".join(spans["ends"].to_pylist()), np.int64), -1)
        keep = np.cumsum(gone[:-1], dtype=np.int32) == 0
        removed, runs, kept = [], [], []
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            k = keep[a:z]
            out = ~k
            removed.append(int(out.sum()))
            runs.append(int(out[0]) + int((out[1:] & k[:-1]).sum()) if len(out) else 0)
            kept.append(b[a:z][k].tobytes() if removed[-1] else b[a:z].tobytes())
        return pa.table({
            **{c: t[c] for c in names}, "_n_bytes": pa.array(np.diff(offsets)), "_n_removed": pa.array(removed, pa.int64()), "_n_spans": pa.array(runs, pa.int64()),
            "_kept": pa.array(kept, pa.binary()), "_kept_text": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()),
        })

    return run


def cut_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of docs by position (c0, c1, ...), and _n_bytes, _n_removed, _n_spans, _kept (bytes) and _kept_text.

    _kept_text drops the odd bytes of a character that a cut went through.
    """
    total = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    blocks, shards = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BLOCK_BYTES))
    at, of = docs.columns.index(text), docs.columns.index(key)
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    hashed = F.when(F.col(f"c{of}").isNull(), F.xxhash64(f"c{at}")).otherwise(F.xxhash64(f"c{of}"))
    dealt = own.select(F.pmod(hashed, F.lit(blocks)).cast("int").alias("_block"), F.col(f"c{of}").cast("bigint").alias("_id"), F.col(f"c{at}").alias("_text"), *[c for c in names if c != f"c{at}"])
    kept_columns = [c for c in names if c != f"c{at}"]
    anchors = dealt.groupBy("_block").applyInArrow(lean_group(_list_anchors(shards)), _LIST)
    shared = anchors.groupBy("b").applyInArrow(lean_group(_shared_anchors), _SHARED)
    runs = dealt.groupBy("_block").cogroup(shared.groupBy("block")).applyInArrow(lean_cogroup(_send_runs(shards)), _RUNS)
    spans = runs.groupBy("b").applyInArrow(lean_group(_find_repeats), _SPANS)
    columns = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in kept_columns)
    return dealt.groupBy("_block").cogroup(spans.groupBy("block")).applyInArrow(lean_cogroup(_cut(kept_columns)), f"{columns}, _n_bytes bigint, _n_removed bigint, _n_spans bigint, _kept binary, _kept_text string")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs."""
    out = cut_repeats(docs.select("doc_id", "text"))
    return out.select(F.col("c0").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """docs with the repeats cut from their texts, and n_chars brought up to date if there is such a column; same columns. Null texts become empty ones."""
    out = cut_repeats(docs, text, key)
    at = docs.columns.index(text)
    columns = []
    for i, c in enumerate(docs.columns):
        if i == at:
            columns.append(F.col("_kept_text").alias(c))
        elif c == n_chars and dict(docs.dtypes)[c] in ("int", "bigint"):
            columns.append(F.length("_kept_text").cast(dict(docs.dtypes)[c]).alias(c))
        else:
            columns.append(F.col(f"c{i}").alias(c))
    return out.select(columns)

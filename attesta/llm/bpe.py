"""Byte-level BPE encoding and decoding by merge ranks.

Texts are split by the tokenizer's pattern, each match is encoded alone. A segment tree over the
byte positions of a match stores the leftmost minimum rank of an adjacent pair; a merge takes the
root, joins the pair and updates the leaves of the live neighbours, each in logarithmic time.
Matches of up to 64 bytes are merged many at a time, each in its own tree, by numpy.

The rank file is a parameter; the driver reads it and broadcasts its bytes (a vocabulary file, of
fixed size). Null text encodes like the empty one: no ids. Texts are never cut, rows stay one for
one, other columns are left out. A key column may not be named ids or decoded.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrays import lean, mix64, steps, text_bytes

#: Chunks kept by a worker, of about 0.1 KB each; when full, those met in one step only are dropped.
CACHE_ENTRIES = 250_000
#: Longer matches are merged one at a time.
BATCH_BYTES = 64
#: Fixed value: the pattern of the public vocabularies. A blank begins a match of it wherever no white space is before it, and a line feed between other characters is a match.
BLANKS_BEGIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a line `base64 rank` for each token."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern. Node i of the tree covers nodes 2i and 2i + 1; leaf size + p holds rank * n + p of the pair that begins at byte p."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    if n < 2:
        raise KeyError(f"byte {piece!r} is not in the vocabulary")
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for p in range(n - 1):
        r = get(piece[p:p + 2])
        if r is not None:
            tree[size + p] = r * n + p
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # where the token at a live position ends
    before = list(range(-1, n))  # where the token before a live position begins; index n is the end
    while tree[1] < _NONE:
        p = tree[1] % n
        q = after[p]  # the pair is p..q, q..e
        e = after[q]
        after[p] = e
        before[e] = p
        changed = [(q, _NONE), (p, _NONE)]
        if e < n:
            r = get(piece[p:after[e]])
            if r is not None:
                changed[1] = (p, r * n + p)
        o = before[p]
        if o >= 0:
            r = get(piece[o:e])
            changed.append((o, _NONE if r is None else r * n + o))
        for leaf, value in changed:
            i = size + leaf
            if tree[i] == value:
                continue
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                a = a if a < b else b
                if tree[i] == a:
                    break
                tree[i] = a
                i >>= 1
    out, p = [], 0
    while p < n:
        out.append(ranks[piece[p:after[p]]])
        p = after[p]
    return out


def lone_space(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text (bytes at[i]..at[i + 1]): it has bytes, and no white space but lone blanks and line feeds.

    Leading bytes of wider white space also begin some punctuation; texts with those count as no.
    """
    space = (b == 32) | (b == 10)
    odd = (b == 9) | (b == 11) | (b == 12) | (b == 13)
    odd |= (b >= 0x1C) & (b <= 0x1F)
    if len(b) > 1:
        a, c = b[:-1], b[1:]
        odd[1:] |= space[:-1] & space[1:]
        odd[1:] |= (a == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (c == 0x9A) | (a == 0xE2) & ((c == 0x80) | (c == 0x81)) | (a == 0xE3) & (c == 0x80)
    inner = np.zeros(len(b) + 1, bool)
    inner[:-1] = odd
    edges = at[:-1][np.diff(at) > 0]
    inner[edges] = np.isin(b[edges], [9, 11, 12, 13, 28, 29, 30, 31])  # what ends the text before is no neighbour
    seen = np.concatenate([[0], np.cumsum(inner)])
    return (seen[at[1:]] == seen[at[:-1]]) & (np.diff(at) > 0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse; not kept, as workers wait with what they keep."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[at[0]:at[0] + size[0]], flat[at[1]:at[1] + size[1]] and so on, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Table:
    """A map from uint64 (not 0) to int64 for arrays of keys: open addressing, at most half full."""

    def __init__(self, room: int):
        self.mask = (1 << (2 * room).bit_length()) - 1
        self.keys, self.values, self.used = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int64), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for unknown keys."""
        at = self._home(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.values[at], -1)
        left = np.flatnonzero((met != keys) & (met != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            met, asked = self.keys[at[left]], keys[left]
            out[left[met == asked]] = self.values[at[left[met == asked]]]
            left = left[(met != asked) & (met != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that differ and are not there yet."""
        if 2 * (self.used + len(keys)) > self.mask:
            old, kept = self.keys != 0, Table(2 * (self.used + len(keys)))
            kept.add(self.keys[old], self.values[old])
            self.__dict__ = kept.__dict__
        self.used += len(keys)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            mine = free[self.keys[at[free]] == keys[free]]
            self.values[at[mine]] = values[mine]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask


class Codec:
    """Encodes and decodes texts; keeps the ids of chunks that it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        tokens = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self._set_up(tokens, pattern)
        self.ranks, self.of_byte = ranks, np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        halves = [(ranks[t[:i]] * self.base + ranks[t[i:]] + 1, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = Table(len(halves))
        self.pairs.add(np.array([k for k, _ in halves], np.uint64), np.array([r for _, r in halves], np.int64))

    def _set_up(self, tokens: list[bytes], pattern: str) -> None:
        """Tables for decoding (the bytes of each id), and the empty store of chunks."""
        import regex

        self.find, self.by_chunk = regex.compile(pattern).findall, pattern == BLANKS_BEGIN
        self.token_sizes = [len(t) for t in tokens]
        self.sizes = np.array(self.token_sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.base = len(tokens)
        self.slots = Table(CACHE_ENTRIES)  # of chunks, by hash
        self.n_slots = self.pool_used = 0
        self.pool = np.zeros(1 << 16, np.int32)
        self.slot_at, self.slot_size, self.slot_hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make; -1 for none."""
        return self.pairs.find((a * self.base + b + 1).astype(np.uint64))

    def _merge_many(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many matches of at most BATCH_BYTES bytes, one after another, and how many each has.

        Row i has its own tree: node j covers nodes 2j and 2j + 1, leaf size + p holds rank * size + p
        of the pair that begins at byte p. In each round every row that has a pair left does one merge.
        """
        n = np.array([len(x) for x in raw], np.int64)
        bits = int(n.max() - 1).bit_length()
        size, m = 1 << bits, len(raw)
        place = np.arange(size)
        alive = place[None, :] < n[:, None]
        token = np.full((m, size), -1, np.int64)
        token[alive] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        if (token[alive] < 0).any():
            raise KeyError("a byte is not in the vocabulary")
        tree = np.full((m, 2 * size), _NONE, np.int64)
        if size > 1:
            row, at = np.nonzero(alive[:, 1:])
            rank = self._pair(token[row, at], token[row, at + 1])
            tree[row, size + at] = np.where(rank < 0, _NONE, (rank << bits) + at)
        low = size >> 1
        while low:
            np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2], out=tree[:, low:2 * low])
            low >>= 1
        after = np.tile(place + 1, (m, 1))  # where the token at a live position ends
        before = np.tile(np.arange(-1, size), (m, 1))  # where the token before a live position begins
        alive, token, tree, after, before = (x.reshape(-1) for x in (alive, token, tree, after, before))

        def update(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            top, i = rows * (2 * size), size + leaf
            tree[top + i] = value
            for _ in range(bits):
                i = i >> 1
                left = top + 2 * i
                tree[top + i] = np.minimum(tree[left], tree[left + 1])

        rows = np.arange(m)
        while len(rows):
            best = tree[rows * (2 * size) + 1]
            rows, best = rows[best < _NONE], best[best < _NONE]
            if not len(rows):
                break
            p, joined, at = best & (size - 1), best >> bits, rows * size
            q = after[at + p]  # the pair is p..q, q..e
            e = after[at + q]
            token[at + p] = joined
            alive[at + q] = False
            after[at + p] = e
            before[rows * (size + 1) + e] = p
            update(rows, q, np.full(len(rows), _NONE))
            more = e < n[rows]
            rank = np.full(len(rows), -1)
            rank[more] = self._pair(joined[more], token[(at + e)[more]])
            update(rows, p, np.where(rank < 0, _NONE, (rank << bits) + p))
            o = before[rows * (size + 1) + p]
            some = o >= 0
            o, r = o[some], rows[some]
            rank = self._pair(token[r * size + o], joined[some])
            update(r, o, np.where(rank < 0, _NONE, (rank << bits) + o))
        return token[alive].astype(np.int32), alive.reshape(m, size).sum(1)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of the pattern, one after another, and how many each has; equal ones are merged once."""
        index = dict.fromkeys(pieces)
        index.update(zip(index, range(len(index)), strict=True))
        which = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        raw = [p.encode() for p in index]
        whole = np.fromiter(map(self.ranks.get, raw, itertools.repeat(-1)), np.int64, len(raw))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        parts, at, count, used = [], np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), 0

        def add(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal used
            at[rows], count[rows] = used + np.cumsum(counts) - counts, counts
            parts.append(ids)
            used += len(ids)

        known = np.flatnonzero(whole >= 0)
        add(known, whole[known].astype(np.int32), np.ones(len(known), np.int64))
        low = 0
        while low < BATCH_BYTES:
            high = max(1, 2 * low)
            rows = np.flatnonzero((whole < 0) & (size > low) & (size <= high))
            for a in range(0, len(rows), 4096):
                add(rows[a:a + 4096], *self._merge_many([raw[i] for i in rows[a:a + 4096].tolist()]))
            low = high
        for i in np.flatnonzero((whole < 0) & (size > BATCH_BYTES)).tolist():
            ids = np.array(merge_bytes(raw[i], self.ranks), np.int32)
            add(np.array([i]), ids, np.array([len(ids)]))
        return gather(np.concatenate(parts), at[which], count[which]), count[which]

    def encode_matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has; for any pattern."""
        found = [self.find(t) for t in texts]
        if not any(found):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ids, counts = self._pieces(list(itertools.chain.from_iterable(found)))
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum([len(x) for x in found])])])

    def encode_all(self, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts with bytes at[i]..at[i + 1] of b: all ids, their n + 1 offsets, all bytes that the ids give back, their n + 1 offsets.

        Where BLANKS_BEGIN is the pattern, texts whose white space is lone are cut into chunks before
        each blank and around each line feed; chunks come again and again, and each distinct one of
        the step, told by a 64-bit hash of its bytes, is looked up once. If what the ids decode to
        differs from the text (hashes that collide), the step is encoded again without chunks.
        """
        plain = lone_space(b, at) if self.by_chunk else np.zeros(len(at) - 1, bool)
        for by_chunk in (plain, np.zeros(len(plain), bool)):
            kept = np.flatnonzero(by_chunk)
            short, n_short = self._chunked(gather(b, at[kept], np.diff(at)[kept]), np.diff(at)[kept])
            rest = np.flatnonzero(~by_chunk)
            other, n_other = self.encode_matches([b[at[i]:at[i + 1]].tobytes().decode() for i in rest.tolist()])
            counts = np.zeros(len(plain), np.int64)
            counts[kept], counts[rest] = n_short, n_other
            begin = np.zeros(len(plain), np.int64)
            begin[kept], begin[rest] = np.cumsum(n_short) - n_short, len(short) + np.cumsum(n_other) - n_other
            ids = gather(np.concatenate([short, other]), begin, counts)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            back = self.decode(ids)
            ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[offsets]
            if np.array_equal(ends, at - at[0]) and np.array_equal(back, b):
                break
        return ids, offsets, back, ends

    def _chunked(self, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without wide white space, and how many each has."""
        if not len(sizes):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        feed = b == 10
        cut = (b == 32) | feed
        cut[1:] |= feed[:-1]
        cut[0] = True
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(b))
        power, inverse = _powers(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * power, out=sums[1:])
        hashes = mix64((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n_slots > CACHE_ENTRIES:
            self._forget()
        distinct |= distinct == 0
        slot = self.slots.find(distinct)
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self._keep(distinct[new], *self._chunks(b, starts[first[new]], stops[first[new]]))
        self.slot_hits[slot] += 1
        slot = slot[which]
        counts = self.slot_size[slot]
        total = np.concatenate([[0], np.cumsum(counts)])
        return gather(self.pool, self.slot_at[slot], counts), np.diff(total[np.concatenate([[0], np.searchsorted(starts, ends)])])

    def _chunks(self, b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and how many each has. Those of more than a byte are matched together, with line feeds between them."""
        lone = np.flatnonzero(stops - starts == 1)
        long = np.flatnonzero(stops - starts > 1)
        single = self.of_byte[b[starts[lone]]]
        if (single < 0).any():
            raise KeyError("a byte is not in the vocabulary")
        at, counts = np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)
        at[lone] = np.arange(len(lone))
        if not len(long):
            return single.astype(np.int32), counts
        sizes = (stops - starts)[long]
        inside = np.ones(sizes.sum() + len(long), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        joined = np.full(len(inside), 10, np.uint8)
        joined[inside] = gather(b, starts[long], sizes)
        pieces = self.find(joined.tobytes().decode())
        ids, n = self._pieces(pieces)
        total = len(lone) + np.concatenate([[0], np.cumsum(n)])
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, pieces), bool, len(pieces)))
        at[long] = total[np.concatenate([[0], ends[:-1] + 1])]
        counts[long] = total[ends] - at[long]
        return gather(np.concatenate([single.astype(np.int32), ids]), at, counts), counts

    def _forget(self) -> None:
        """Keep the chunks that more than one step met since the last time, at most half of what fits."""
        keys, k = self.slots.keys[self.slots.keys != 0], self.slots.values[self.slots.keys != 0]
        old = np.flatnonzero(self.slot_hits[k] > 1)[: CACHE_ENTRIES // 2]
        ids, counts = gather(self.pool, self.slot_at[k[old]], self.slot_size[k[old]]), self.slot_size[k[old]]
        self.slots = Table(CACHE_ENTRIES)
        self.n_slots = self.pool_used = 0
        self._keep(keys[old], ids, counts)

    def _keep(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        k, used = self.n_slots + np.arange(len(keys)), self.pool_used
        if used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (used + len(ids)))
        if self.n_slots + len(keys) > len(self.slot_at):
            self.slot_at, self.slot_size, self.slot_hits = (np.resize(x, 2 * (self.n_slots + len(keys))) for x in (self.slot_at, self.slot_size, self.slot_hits))
        self.pool[used:used + len(ids)] = ids
        self.slot_at[k], self.slot_size[k], self.slot_hits[k] = used + np.cumsum(counts) - counts, counts, 0
        self.slots.add(keys, k)
        self.pool_used, self.n_slots = used + len(ids), self.n_slots + len(keys)
        return k

    def encode(self, text: str) -> np.ndarray:
        return self.encode_matches([text])[0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[ids], self.sizes[ids])


_CODECS: dict[int, Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec a worker process, so its cache lives on from task to task."""
    key = hash((data, pattern))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(data), pattern)
    return _CODECS[key]


def _rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(df: DataFrame, text: str, key: str, ranks_path: str, pattern: str) -> DataFrame:
    """key and ids (array<int>) of every whole text, without special tokens."""
    return _coded(df, text, key, ranks_path, pattern, False)


def bpe_round_trip(df: DataFrame, text: str, key: str, ranks_path: str, pattern: str) -> DataFrame:
    """key, ids, and decoded: the bytes that the ids give back."""
    return _coded(df, text, key, ranks_path, pattern, True)


def _coded(df: DataFrame, text: str, key: str, ranks_path: str, pattern: str, back: bool) -> DataFrame:
    if key in ("ids", "decoded"):
        raise ValueError(f"the key column may not be named {key}")
    data = df.sparkSession.sparkContext.broadcast(_rank_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern)
        for batch in batches:
            for part in steps(batch, "_text", 1 << 20):
                ids, offsets, decoded, ends = codec.encode_all(*text_bytes(part["_text"]))
                columns = [part["_key"], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
                if back:
                    columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(decoded)]))
                yield pa.RecordBatch.from_arrays(columns, ["_key", "ids", "decoded"][: len(columns)])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(lean(run), f"_key {kind}, ids array<int>" + ", decoded binary" * back).withColumnRenamed("_key", key)


def bpe_decode(df: DataFrame, ids: str, key: str, ranks_path: str, pattern: str) -> DataFrame:
    """key and decoded bytes of an array<int> column; null gives no bytes. An id outside the vocabulary is an error."""
    data = df.sparkSession.sparkContext.broadcast(_rank_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["_key"], pa.array([codec.decode(np.array(x or [], np.int32)).tobytes() for x in batch["_ids"].to_pylist()], pa.binary())], ["_key", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(lean(run), f"_key {kind}, decoded binary").withColumnRenamed("_key", key)


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, for each row of docs."""
    return bpe_round_trip(docs, "text", "doc_id", ranks_path, pattern).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )

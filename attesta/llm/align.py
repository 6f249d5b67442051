"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

Texts are encoded with a byte-level vocabulary (A, backtrack.py) and a sentencepiece model (B), both
over a space and the text. A task does this for about 0.5 MB of texts at a time, and for all their tokens
at once:

1. Cumulative lengths over the tokens of a side say where a token begins, which is where the one before
   it ends.
2. The two sides are joined on document and place: tokens that begin at one place make one row, others
   a row with one side empty. A row with both sides is a cut; the running count of cuts numbers the groups.
3. Each row of the join is a piece of text that one A and one B token cover, so it is one link: the
   last A and the last B token that began. A group of m and k tokens has m + k - 1 links at most, and
   they come without pairing the group's tokens with each other.

Documents lie whole in a task, so no token is shuffled. What holds over all documents is Spark's:

4. Links are counted by id pair, in each task first. Pairs that hold at least 1 / FREQUENT of all links,
   FREQUENT of them at most, are sent to all tasks; the links of the others are summed by document and
   pair and joined by a shuffle.

Null and empty texts, and those whose A or B bytes differ from the space and the text (a U+2581 in the
text, say), have no tokens. Rows that repeat an id are documents of their own; null ids are kept. Texts
are never cut. Other columns, of any name, are left out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrays import give_back, lean, steps, text_bytes
from attesta.llm.backtrack import Backtracking, file_bytes
from attesta.llm.bpe import BLANKS_BEGIN, Codec, Table, gather
from attesta.session import materialize

#: Bytes of text that are aligned at once, and links and pairs that a task counts before it sends their counts on.
TASK_BYTES, HELD = 1 << 19, 1 << 19
#: Links of a document that go to a worker as one row.
SLICE = 128
#: Pairs with a share of at least 1 / FREQUENT of all links are broadcast.
FREQUENT = 100_000


def piece_bytes(piece: str) -> bytes:
    """What a sentencepiece token stands for."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pieces(Codec):
    """A sentencepiece model over texts that begin with the space that it adds itself.

    Chunks (see Codec) are encoded once if no token joins a space, or a line feed, to what is before it.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self._set_up([piece_bytes(p) for p in pieces], BLANKS_BEGIN)
        self.by_chunk = not any("▁" in p.lstrip("▁") or len(p) > 1 and "\n" in p for p in pieces)

    def encode_matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode([t[1:] for t in texts], num_threads=1) if texts else []
        return _flat(ids)

    def _chunks(self, b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # behind a line feed a chunk stands as it is; the model's own space and the line feed go again
        n = stops - starts
        behind = np.cumsum(n + 1)
        joined = np.full(int(behind[-1]) if len(n) else 0, 10, np.uint8)
        own = np.ones(len(joined), bool)
        own[behind - n - 1] = False
        joined[own] = gather(b, starts, n)
        data = joined.tobytes()
        ids, counts = _flat(self.model.encode([data[a:z].decode() for a, z in zip((behind - n - 1).tolist(), behind.tolist(), strict=True)], num_threads=1))
        first = np.cumsum(counts) - counts
        return gather(ids, first + 2, counts - 2), counts - 2


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.int32, counts.sum()), counts


_CODECS: dict[int, tuple[Codec, Codec]] = {}


def _codecs(a: bytes, b: bytes) -> tuple[Codec, Codec]:
    key = hash((a, b))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = (Backtracking(a, special=False), Pieces(b))
    return _CODECS[key]


def encode_both(codecs: tuple[Codec, Codec], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A's ids of all texts, one text after another, how many every text has, and the same of B."""
    raw, at = text_bytes(texts)
    full = np.flatnonzero(np.diff(at) > 0)
    spaced = at[:-1][full] + np.arange(len(full))
    offsets = np.append(spaced, len(raw) + len(full))
    data = np.full(len(raw) + len(full), 32, np.uint8)
    text = np.ones(len(data), bool)
    text[spaced] = False
    data[text] = raw
    sides, good = [], np.ones(len(full), bool)
    for codec in codecs:
        ids, of, back, ends = codec.encode_all(data, offsets)
        if not (np.array_equal(ends, offsets) and np.array_equal(back, data)):
            for i in range(len(full)):
                good[i] &= back[ends[i]:ends[i + 1]].tobytes() == data[offsets[i]:offsets[i + 1]].tobytes()
        sides.append((ids, of[:-1], np.diff(of)))
    out = []
    for ids, begin, n in sides:
        n = np.where(good, n, 0)
        counts = np.zeros(len(at) - 1, np.int64)
        counts[full] = n
        out += [gather(ids, begin, n).astype(np.int32), counts]
    return tuple(out)


def join_sides(size_a: np.ndarray, n_a: np.ndarray, size_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The links of texts whose tokens have these sizes, n_a and n_b of each text: which A and which B token, whether they begin here, the byte of the text, and the cuts so far in all texts.

    Both sides cover the same bytes, so places count through all texts, and a text's first tokens begin together.
    """
    at_a, at_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    total = int(size_a.sum())
    begins_a, begins_b = np.zeros(total, bool), np.zeros(total, bool)
    begins_a[at_a] = True
    begins_b[at_b] = True
    place = np.flatnonzero(begins_a | begins_b)
    new_a, new_b = begins_a[place], begins_b[place]
    a, b = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
    first = np.repeat(at_a[(np.cumsum(n_a) - n_a)[n_a > 0]], n_a[n_a > 0])  # of each A token, where its text begins
    return a, b, new_a, new_b, place - first[a], np.cumsum(new_a & new_b)


def _mapped(docs: DataFrame, text: str, key: str, a_path: str, b_path: str, run, columns: str) -> DataFrame:
    """What run makes of each step of texts: a function of the rows and keys, A's and B's ids and counts, and what join_sides returns."""
    spark = docs.sparkSession
    a, b = (spark.sparkContext.broadcast(file_bytes(p)) for p in (a_path, b_path))

    def steps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "_text", TASK_BYTES):
                codecs = _codecs(a.value, b.value)
                ids_a, n_a, ids_b, n_b = encode_both(codecs, part["_text"])
                yield run(part["_row"], part["_key"], ids_a, n_a, ids_b, n_b, *join_sides(codecs[0].sizes[ids_a], n_a, codecs[1].sizes[ids_b], n_b))
                give_back()

    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    return texts.mapInArrow(lean(steps_of), f"_row bigint, _key {docs.schema[key].dataType.simpleString()}, {columns}")


def aligned(docs: DataFrame, text: str, key: str, a_path: str, b_path: str) -> DataFrame:
    """A row for each link: _row (the document), _key, place (the byte of the space and the text where the link begins), a, b (ids), new_a, new_b (whether they begin here) and group_id (from 1 on).

    A document without tokens has no row.
    """

    def run(rows, keys, ids_a, n_a, ids_b, n_b, a, b, new_a, new_b, place, cuts) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(n_a)), n_a)[a]
        begin = np.append(0, cuts)[np.searchsorted(of, of)]
        kept = pa.array(of)
        columns = [rows.take(kept), keys.take(kept), *(pa.array(x) for x in (place.astype(np.int32), ids_a[a], ids_b[b], new_a, new_b, cuts - begin))]
        return pa.RecordBatch.from_arrays(columns, ["_row", "_key", "place", "a", "b", "new_a", "new_b", "group_id"])

    return _mapped(docs, text, key, a_path, b_path, run, "place int, a int, b int, new_a boolean, new_b boolean, group_id bigint")


_NESTED = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, a array<int>, b array<int>"


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decimal digits of 0..n - 1 with a byte for a separator behind each; where each begins, and its size."""
    words = [b"%d " % i for i in range(n)]
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size


def groups_text(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, decimals: tuple) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of tokens and their groups, which ascend, and where each group ends."""
    if not len(a):
        return b"", np.zeros(0, np.int64)
    flat, at, size = decimals
    ids, group = np.concatenate([a, b]), np.concatenate([group_a, group_b])
    end = np.full(len(ids), ord(","), np.uint8)
    end[np.append(np.flatnonzero(np.diff(group_a)), len(a) - 1)] = ord("|")
    end[len(a) + np.append(np.flatnonzero(np.diff(group_b)), len(b) - 1)] = ord(";")
    order = np.argsort(group, kind="stable")  # of a group first A's tokens, then B's
    n = size[ids[order]]
    text = gather(flat, at[ids[order]], n)
    ends, last = np.cumsum(n), end[order]
    text[ends - 1] = last
    return text.tobytes(), ends[last == ord(";")]


def align(docs: DataFrame, text: str, key: str, a_path: str, b_path: str) -> DataFrame:
    """_row, _key, n_a, n_b, n_groups, groups_sha256 (of the groups written as `a1,a2|b1;a3|b2,b3`; without tokens ''), a and b (the ids of each link) of each row of docs, stored."""
    kept: list = []

    def run(rows, keys, ids_a, n_a, ids_b, n_b, a, b, new_a, new_b, place, cuts) -> pa.RecordBatch:
        most = max(ids_a.max(initial=0), ids_b.max(initial=0)) + 1
        if not kept or len(kept[0][2]) < most:
            kept[:] = [_decimals(max(int(most), 1 << 16))]
        whole, ends = groups_text(ids_a, ids_b, cuts[new_a], cuts[new_b], kept[0])
        of = np.repeat(np.arange(len(n_a)), n_a)[a]
        last = np.searchsorted(of, np.arange(len(n_a)), "right")  # behind each text's links
        groups = np.diff(np.append(0, np.append(0, cuts)[last]))
        stop = np.append(0, ends)[np.cumsum(groups)]
        start = np.append(0, stop[:-1])
        digests = [hashlib.sha256(whole[x:z - 1]).hexdigest() if z > x else "" for x, z in zip(start.tolist(), stop.tolist(), strict=True)]
        offsets = pa.array(np.append(0, last).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids_a[a], ids_b[b])]
        return pa.RecordBatch.from_arrays([rows, keys, *(pa.array(x) for x in (n_a, n_b, groups, digests)), *lists], ["_row", "_key", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b"])

    return materialize(_mapped(docs, text, key, a_path, b_path, run, _NESTED), "aligned")


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The links of documents as one number each, and n + 1 offsets."""
    n = pa.compute.list_value_length(batch["a"]).to_numpy()
    a, b = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("a", "b"))
    return a << 32 | b, np.append(0, np.cumsum(n))


def _sliced(documents: DataFrame, *columns: str) -> DataFrame:
    """columns, and a and b by SLICE links a row: a batch of rows is sent to a task's worker at once, whatever they hold."""
    begins = F.expr(f"sequence(1, size(a), {SLICE})")
    pieces = F.explode(F.transform(begins, lambda i: F.struct(F.slice("a", i, SLICE).alias("a"), F.slice("b", i, SLICE).alias("b"))))
    return documents.where(F.size("a") > 0).select(*columns, pieces.alias("_p")).select(*columns, "_p.a", "_p.b")


def pair_counts(documents: DataFrame) -> DataFrame:
    """a, b, n (links of the pair over all documents) and best (whether no A token has more links with this B token). documents: as align() returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _CODECS.clear()  # the worker has encoded before and needs them no more
        held, size = [], 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            pairs, which = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(which, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            pairs, n = counted()
            return pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            for part in steps(batch, "a", 1 << 21):
                pairs, n = np.unique(_pairs(part)[0], return_counts=True)
                held.append((pairs, n))
                size += len(pairs)
                give_back()
                if size > HELD:
                    held = [counted()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield rows()
                        held, size = [], 0
        if held:
            yield rows()

    own = _sliced(documents).mapInArrow(lean(run), "a int, b int, n bigint")
    counts = materialize(own.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    most = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("_most")))  # one row a token of B's vocabulary at most
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("_most")).cast("int").alias("best"))


def link_sums(documents: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """_row, n_best and count_sum of each document that has links."""
    spark = documents.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * frequent >= F.lit(total)  # at most `frequent` pairs
    t = counts.where(often).toArrow()
    known = spark.sparkContext.broadcast(tuple(t[c].to_numpy() for c in ("a", "b", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _CODECS.clear()
        a, b, n, best = known.value
        place = Table(max(1, len(n)))
        place.add((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1), np.arange(len(n)))
        n, best = np.append(n, 0), np.append(best, 0)  # place -1: a rare pair
        for batch in batches:
            for part in steps(batch, "a", 1 << 21):
                pairs, at = _pairs(part)
                found = place.find(pairs.astype(np.uint64) + np.uint64(1))
                sums = [np.diff(np.append(0, np.cumsum(x[found]))[at]) for x in (best, n)]
                rare = found < 0
                offsets = pa.array(np.append(0, np.cumsum(rare))[at].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[rare].astype(np.int32))) for x in (pairs >> 32, pairs & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays([part["_row"], *(pa.array(x.astype(np.int64)) for x in sums), *lists], ["_row", "n_best", "count_sum", "a", "b"])

    met = materialize(_sliced(documents, "_row").mapInArrow(lean(run), "_row bigint, n_best bigint, count_sum bigint, a array<int>, b array<int>"), "link-sums")
    links = met.select("_row", F.explode(F.arrays_zip("a", "b")).alias("l")).groupBy("_row", F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.count("*").alias("_k"))
    rare = links.join(counts.where(~often), ["a", "b"]).groupBy("_row").agg(F.sum(F.col("best") * F.col("_k")).alias("n_best"), F.sum(F.col("n") * F.col("_k")).alias("count_sum"))
    return met.select("_row", "n_best", "count_sum").unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs."""
    documents = align(docs, "text", "doc_id", a_path, b_path)
    sums = link_sums(documents, pair_counts(documents))
    figures = documents.select("_row", F.col("_key").alias("doc_id"), "n_a", "n_b", "n_groups", F.size("a").cast("bigint").alias("n_links"), "groups_sha256")
    none = F.lit(0).cast("bigint")
    return figures.join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")

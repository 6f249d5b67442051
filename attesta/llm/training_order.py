"""Token-id output in training order.

Texts become token ids, cut into sequences of a fixed length (the last one of a text is padded).
Sequences are numbered by (doc_id, 128-bit hash of the text, place in the text), so the numbers depend
on the data alone. A keyed Feistel permutation over the next power of four, walked along its cycle
until it lands inside, gives each number its global slot: a bijection that any task computes alone.
Slots are dealt by range to shards, one task a shard, which writes records of a fixed stride:

    header, 64 bytes: magic, version, tokens a sequence, bytes a token, sequences, first slot, all sequences, key, input fingerprint
    record: doc_id int64, place int32, tokens used int32, the token ids (little-endian, zero-padded)

so slot s lies at 64 + (s - first slot) * stride and reading may resume anywhere. A shard is written
under another name and then renamed; one that is there in full with the same header, so of the same
input and key, is kept, so a job can be run again.

Tokens are a column of ids that another operator made (array<int>, 2 or 4 bytes each), or the UTF-8
bytes of a text (a vocabulary of 256, one byte each). Null or empty texts make one sequence without tokens. Rows that repeat both doc_id
and text are stored once. A null doc_id is written as -2**63.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from attesta.llm.arrays import lean, lean_group, steps, text_bytes
from attesta.session import materialize, shared_dir

MAGIC = b"SEQSHARD"
HEADER = "<8sIIIQQQQQ4x"
RECORD = np.dtype([("doc_id", "<i8"), ("place", "<i4"), ("used", "<i4")])
NULL_ID = -(1 << 63)
#: First numbers of up to this many documents are broadcast (about 140 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A permutation of 0..n-1, applied to numbers below n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF) for r in range(rounds)]
    out = x.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def _count(docs: DataFrame, text: str) -> Column:
    """Tokens of each row."""
    return F.coalesce(F.size(text) if isinstance(docs.schema[text].dataType, ArrayType) else F.octet_length(text), F.lit(0))


def _tokens(a: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of an array of texts or of lists of ids, and n + 1 offsets; nulls are empty."""
    if not pa.types.is_list(a.type):
        return text_bytes(a)
    values = a.flatten()
    if values.null_count:
        raise ValueError("an id is null")
    values = values.to_numpy()
    if len(values) and not 0 <= values.min() <= values.max() < 1 << 8 * width:
        raise ValueError(f"an id from {values.min()} to {values.max()} does not fit {width} bytes")
    sizes = pa.compute.fill_null(pa.compute.list_value_length(a), 0).to_numpy()
    return values.astype(f"<u{width}"), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _hashes(text: str) -> tuple[Column, Column]:
    """Two hashes of a text or of ids, with different seeds."""
    return F.xxhash64(text).alias("hash"), F.xxhash64(F.lit("again"), text).alias("hash2")


def number_sequences(docs: DataFrame, text: str, key: str, length: int, buckets: int = 1024) -> tuple[DataFrame, int, int]:
    """doc, hash, hash2, tokens and first (the number of the first sequence) of each different row, the count of all sequences, and a fingerprint of the rows.

    text: a column of texts, whose bytes are the tokens, or of ids.

    Running sums inside hash buckets, on top of the sums of the buckets before: only `buckets` rows meet in one task.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), *_hashes(text), _count(docs, text).alias("tokens")).distinct()
    rows = materialize(rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("tokens") / length)).cast("bigint")).withColumn("bucket", F.pmod(F.xxhash64("doc", "hash"), F.lit(buckets))), "order-documents")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    fingerprint = rows.agg(F.bit_xor(F.xxhash64("doc", "hash", "hash2", "tokens"))).first()[0] or 0
    base = sums.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("doc", "hash", "hash2", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(rows.join(F.broadcast(base), "bucket").select("doc", "hash", "hash2", "tokens", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first")), "order-numbers"), int(total), fingerprint & (1 << 64) - 1


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_shards(docs: DataFrame, out: str, text: str = "text", key: str = "doc_id", length: int = 1024, shard_sequences: int = 8192, seed: int = 1, width: int = 4) -> DataFrame:
    """Write all sequences of docs to shards in the folder out, which driver and executors share; the manifest: shard, path, first_slot, sequences, bytes.

    text: a column of texts, or of ids (array<int>) that are stored in `width` bytes each; a larger id is an error.
    """
    import zstandard

    if not isinstance(docs.schema[text].dataType, ArrayType):
        width = 1
    elif width not in (2, 4):
        raise ValueError("ids take 2 or 4 bytes")
    numbers, total, fingerprint = number_sequences(docs, text, key, length)
    stride = RECORD.itemsize + length * width
    numbers = F.broadcast(numbers) if numbers.count() <= BROADCAST_ROWS else numbers
    own = docs.select(F.col(key).cast("bigint").alias("_doc"), F.col(text).alias("_text"), *(h.alias(f"_hash{i}") for i, h in enumerate(_hashes(text))), _count(docs, text).alias("_count"))
    named = own.join(numbers, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_hash0") == F.col("hash")) & (F.col("_hash1") == F.col("hash2")) & (F.col("_count") == F.col("tokens"))).select("_doc", "_text", "first")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in steps(batch, "_text"):
                b, offsets = _tokens(part["_text"], width)
                sizes = np.diff(offsets)
                n = np.maximum(1, -(-sizes // length))
                of = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                used = np.minimum(length, sizes[of] - place * length).astype(np.int32)
                record = np.zeros(len(of), np.dtype([*RECORD.descr, ("tokens", f"<u{width}", (length,))]))
                record["doc_id"] = part["_doc"].fill_null(NULL_ID).to_numpy(zero_copy_only=False)[of]
                record["place"], record["used"] = place, used
                # whole sequences are copied as rows; texts' ends fill up with zeros
                flat = np.zeros((len(of), length), f"<u{width}")
                flat[np.arange(length)[None, :] < used[:, None]] = b
                record["tokens"] = flat
                slot = feistel(part["first"].to_numpy()[of] + place, total, seed)
                order = np.argsort(slot)
                shard = slot[order] // shard_sequences
                at = np.flatnonzero(np.diff(shard, prepend=-1))
                rows = [(int(shard[a]), order[a:z]) for a, z in zip(at, np.append(at[1:], len(order)), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in rows], pa.int64()), pa.array([slot[i].tobytes() for _, i in rows], pa.binary()), pa.array([packer.compress(record[i].tobytes()) for _, i in rows], pa.binary())], ["shard", "slots", "records"]
                )

    def store(t: pa.Table) -> pa.Table:
        shard = t["shard"][0].as_py()
        first, count = shard * shard_sequences, min(shard_sequences, total - shard * shard_sequences)
        size = 64 + count * stride
        target, base = _filesystem(out)
        path = f"{base}/shard-{shard:08d}.bin"
        header = struct.pack(HEADER, MAGIC, 2, length, width, count, first, total, seed, fingerprint)
        kept = target.get_file_info(path).size == size
        if kept:
            with target.open_input_file(path) as f:
                kept = f.read(64) == header
        if not kept:
            data = np.zeros((count, stride), np.uint8)
            for slots, records in zip(t["slots"].to_pylist(), t["records"].to_pylist(), strict=True):
                at = np.frombuffer(slots, np.int64) - first
                data[at] = np.frombuffer(zstandard.ZstdDecompressor().decompress(records, max_output_size=len(at) * stride), np.uint8).reshape(len(at), stride)
            target.create_dir(base, recursive=True)
            partial = f"{base}/.{shard:08d}-{uuid.uuid4().hex}"
            with target.open_output_stream(partial) as f:
                f.write(header)
                f.write(data.tobytes())
            target.move(partial, path)
        return pa.table({"shard": [shard], "path": [f"{out}/shard-{shard:08d}.bin"], "first_slot": [first], "sequences": [count], "bytes": [size]})

    sent = named.mapInArrow(lean(send), "shard bigint, slots binary, records binary")
    return materialize(sent.groupBy("shard").applyInArrow(lean_group(store), "shard bigint, path string, first_slot bigint, sequences bigint, bytes bigint"), "order-manifest")


def read_shards(manifest: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """slot, shard, offset, doc_id, place, n_tokens and tokens (their little-endian bytes) of the slots first..last, read in order within each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch["shard"].to_pylist(), batch["path"].to_pylist(), strict=True):
                source, at = _filesystem(path)
                with source.open_input_file(at) as f:
                    magic, _, length, width, count, begin, _, _, _ = struct.unpack(HEADER, f.read(64))
                    if magic != MAGIC:
                        raise ValueError(f"{path} is no shard")
                    kind = np.dtype([*RECORD.descr, ("tokens", "u1", (length * width,))])
                    a, z = max(0, first - begin), count if last is None else min(count, last + 1 - begin)
                    while a < z:
                        n = min(4096, z - a)
                        record = np.frombuffer(f.read_at(n * kind.itemsize, 64 + a * kind.itemsize), kind)
                        slot = begin + a + np.arange(n)
                        ids = pa.array(record["doc_id"], mask=record["doc_id"] == NULL_ID)
                        tokens = pa.array([x[: u * width].tobytes() for x, u in zip(record["tokens"], record["used"].tolist(), strict=True)], pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(slot), pa.array(np.full(n, shard)), pa.array(64 + (slot - begin) * kind.itemsize), ids, pa.array(record["place"].copy()), pa.array(record["used"].astype(np.int64)), tokens],
                            ["slot", "shard", "offset", "doc_id", "place", "n_tokens", "tokens"],
                        )
                        a += n

    wanted = manifest.where((F.col("first_slot") + F.col("sequences") > first) & (F.lit(True) if last is None else F.col("first_slot") <= last)).select("shard", "path")
    tasks = max(1, min(wanted.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))  # a shard is a file; a task reads whole ones
    return wanted.repartitionByRange(tasks, "shard").mapInArrow(lean(run), "slot bigint, shard bigint, offset bigint, doc_id bigint, place int, n_tokens bigint, tokens binary")


def training_order(spark: SparkSession, docs: DataFrame, text: str = "text", length: int = 1024, shard_sequences: int = 8192, seed: int = 1, width: int = 4) -> DataFrame:
    """Write docs as shards in the session's shared folder and read every sequence back: its slot, place in the shards and a checksum of its tokens."""
    manifest = write_shards(docs, f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}", text, length=length, shard_sequences=shard_sequences, seed=seed, width=width)
    return read_shards(manifest).withColumn("tokens_crc32", F.crc32("tokens")).drop("tokens")

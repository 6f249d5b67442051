"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every magic number in one pass over the bytes; a validator of the
format then walks the structure from that place and gives the exact length, or rejects it. The
validated item at offset 0 corrects the declared type, the others are carved as embedded media.

Null content counts as empty: type application/octet-stream and nothing carved.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrays import lean, steps

UNKNOWN = "application/octet-stream"

#: Magic numbers, the offset of the magic in its file, and the type.
MAGICS = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"ftyp", 4, "video/mp4"),
]
#: Form types of RIFF files.
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or first and kind != b"IHDR":
            return None
        if zlib.crc32(b[p + 4:end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0x00 or 0xD0 <= kind <= 0xD8:
            return None
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2:
            return None
        p += 2 + size
        if kind == 0xDA:  # entropy-coded data runs up to a marker that is neither stuffing nor a restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return p + 2 - at if b[p:p + 2] == b"\xff\xd9" else None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    images = 0
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at if images else None
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
            images += 1
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, pixels, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    good = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return size if good and 14 + header <= pixels <= size <= len(b) - at else None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b) or b[at + 8:at + 12] not in RIFF_FORMS:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, chunks = at + 12, 0
    if end > len(b):
        return None
    while p + 8 <= end:
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + (size & 1)
        chunks += 1
    return end - at if chunks and p in (end, end + 1) else None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks; FLAC frames hold no lengths, so the item ends with its file."""
    p, first = at + 4, True
    while p + 4 <= len(b):
        last, kind = b[p] >> 7, b[p] & 127
        size = int.from_bytes(b[p + 1:p + 4], "big")
        if first and (kind != 0 or size != 34) or kind == 127:
            return None
        p, first = p + 4 + size, False
        if p > len(b):
            return None
        if last:
            return len(b) - at
    return None


def _ogg(b: bytes, at: int) -> int | None:
    p, pages, serial = at, 0, None
    while b[p:p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        n, own = b[p + 26], b[p + 14:p + 18]
        if pages == 0 and not b[p + 5] & 2:
            return None
        if serial is not None and own != serial:
            break
        end = p + 27 + n + sum(b[p + 27:p + 27 + n])
        if end > len(b):
            return None
        serial, last = own, b[p + 5] & 4
        p, pages = end, pages + 1
        if last:
            break
    return p - at if pages else None


def _pdf(b: bytes, at: int) -> int | None:
    if not b[at + 5:at + 6].isdigit():
        return None
    following = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, following if following > 0 else len(b))
    return end + 5 - at if end > 0 and b.rfind(b"startxref", at, end) > 0 else None


def _zip(b: bytes, at: int) -> int | None:
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        if offset + size == end - at and (size == 0 or b[at + offset:at + offset + 4] == b"PK\x01\x02"):
            return end + 22 + note - at if end + 22 + note <= len(b) else None
        end = b.find(b"PK\x05\x06", end + 4)
    return None


def _mp4(b: bytes, at: int) -> int | None:
    p, kinds = at, []
    while p + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        head = 8
        if size == 1 and p + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, p + 8)[0], 16
        if size < head or p + size > len(b) or not kind.isalnum():
            break
        kinds.append(kind)
        p += size
    return p - at if kinds[:1] == [b"ftyp"] and {b"moov", b"moof"} & set(kinds) else None


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac,
    "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "video/mp4": _mp4,
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, lead, kind in MAGICS:
        a.add_word(magic.decode("latin-1"), (len(magic) + lead, kind))
    a.make_automaton()
    return a


def find_media(b: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every validated item, by offset; nested items are listed too."""
    found = []
    covered: dict[str, int] = {}
    for end, (back, kind) in _automaton().iter(b.decode("latin-1")):
        at = end + 1 - back
        if at < covered.get(kind, 0) and kind == "audio/ogg" or at < 0:
            continue  # later pages of a stream that is already carved
        size = VALIDATORS[kind](b, at)
        if size:
            covered[kind] = at + size
            found.append((RIFF_FORMS[b[at + 8:at + 12]] if kind == "riff" else kind, at, size))
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """Bytes as the 8-bit mono samples of a WAV file, lossless."""
    odd = b"\0" * (len(samples) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(odd), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + odd


def from_wav(wav: bytes) -> bytes:
    """The data chunk of a WAV file, found by walking its chunks."""
    p, end = 12, 8 + struct.unpack_from("<I", wav, 4)[0]
    while p + 8 <= end:
        kind, size = struct.unpack_from("<4sI", wav, p)
        if kind == b"data":
            return wav[p + 8:p + 8 + size]
        p += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def padded(raw: bytes, unit: int = 64) -> bytes:
    """raw with zero bytes up to a positive multiple of unit."""
    return raw + b"\0" * (-len(raw) % unit or (0 if raw else unit))


ITEMS = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
_SNIFFED = "detected string, corrected boolean, items array<struct<type:string,offset:bigint,length:bigint>>"


def _judged(b: bytes | None, declared: str | None) -> tuple[str, bool, list[dict]]:
    found = find_media(b) if b else []
    detected = next((kind for kind, at, _ in found if at == 0), UNKNOWN)
    return detected, detected != UNKNOWN and detected != declared, [dict(zip(("type", "offset", "length"), x, strict=True)) for x in found]


def sniff_media(df: DataFrame, content: str, declared: str, key: str) -> DataFrame:
    """key, the detected type, whether it corrects the declared one, and all items carved from a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "_content"):
                got = [_judged(b, d) for b, d in zip(part["_content"].to_pylist(), part["_declared"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["_key"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], ITEMS)], ["_key", "detected", "corrected", "items"])

    kind = df.schema[_free_key(key, ("detected", "corrected", "items"))].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(content).cast("binary").alias("_content"), F.col(declared).alias("_declared")).mapInArrow(lean(run), f"_key {kind}, {_SNIFFED}").withColumnRenamed("_key", key)


def carve_media(df: DataFrame, content: str, items: str) -> DataFrame:
    """One row per item with its own bytes in column carved; df needs the columns of sniff_media."""
    return df.withColumn("item", F.explode(items)).withColumn("carved", F.substring(F.col(content), F.col("item.offset").cast("int") + 1, F.col("item.length").cast("int")))


def signal_features(payload: bytes) -> str:
    """Of 8-bit samples around 128: mean, root of the mean square, peak, crossings of the middle, and different values."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    if not len(samples):
        return "mean=0.000,rms=0.000,peak=0,crossings=0,values=0"
    above = samples >= 0
    return f"mean={samples.mean():.3f},rms={np.sqrt((samples * samples).mean()):.3f},peak={np.abs(samples).max()},crossings={np.count_nonzero(above[1:] != above[:-1])},values={np.count_nonzero(np.bincount(samples + 128))}"


def _free_key(key: str, taken: tuple[str, ...]) -> str:
    if key in taken:
        raise ValueError(f"the key column may not be named {key}")
    return key


def store_media(df: DataFrame, text: str, key: str, unit: int = 64) -> DataFrame:
    """Store whole texts as media: key, n_bytes, media (a WAV file), payload as read back, what sniffing says of it, and features of its samples.

    The payload is carved from the stored form at the place that sniffing found, so a wrong declared type does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "_text"):
                raw = [(t or "").encode() for t in part["_text"].to_pylist()]
                media = [to_wav(padded(b, unit)) for b in raw]
                got = [_judged(m, "text/plain") for m in media]
                back = [from_wav(m[g[2][0]["offset"]:g[2][0]["offset"] + g[2][0]["length"]]) for m, g in zip(media, got, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["_key"], pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], ITEMS), pa.array(map(signal_features, back), pa.string())],
                    ["_key", "n_bytes", "media", "payload", "detected", "corrected", "items", "signal"],
                )

    kind = df.schema[_free_key(key, ("n_bytes", "media", "payload", "detected", "corrected", "items", "signal"))].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(lean(run), f"_key {kind}, n_bytes bigint, media binary, payload binary, {_SNIFFED}, signal string").withColumnRenamed("_key", key)


def media_digests(docs: DataFrame) -> DataFrame:
    """Digest columns of store_media over the whole texts of docs; null text counts as empty, repeated rows stay."""
    tail = F.expr("substring(payload, -64, 64)")
    items = F.transform("items", lambda x: F.concat(x["type"], F.lit("@"), x["offset"].cast("string"), F.lit("+"), x["length"].cast("string")))
    return store_media(docs, "text", "doc_id").select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat_ws(";", "detected", F.array_join(items, ","), "signal").alias("feature"),
    )

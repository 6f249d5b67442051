"""Byte-level BPE by longest matches and backtracking, for vocabulary files with a list of merges.

An Aho-Corasick automaton over the reversed tokens reads a match of the pattern from its end, and so
finds the longest token that begins at each byte in one pass. Encoding takes the longest token, and
keeps it if it is compatible with the token before it; else it takes the next shorter prefix that
is a token, and goes back a token where none is left. A row of tokens is what the merges give just
when each neighbouring pair is compatible, so the result is exact. A place where no token fitted is
marked and never tried again, so the time is linear in the bytes.

Two tokens are compatible if no merge crosses the border between them. That is decided by taking
their own merges back, the latest first, and is kept in a table of pairs of at most PAIRS entries.
Decoding gathers bytes by a table of offsets.

Added tokens of the file are found in texts first, as the library does, and are one id each; their
options to strip or to match whole words are not supported and raise an error. Null text encodes
like the empty one: no ids. Texts are never cut, rows stay one for one (repeated rows and keys
too), other columns are left out. A key column may not be named ids or decoded.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrays import lean, steps, text_bytes
from attesta.llm.bpe import BLANKS_BEGIN, Codec, gather

#: Pairs whose compatibility a worker keeps; beyond, the table starts anew.
PAIRS = 300_000
_NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(data: bytes) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[bytes, int]]:
    """Ids of tokens, the merges in their order, and ids of added tokens of a tokenizer file."""
    file = json.loads(data)
    if (file.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or file.get("normalizer") or file["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("the file must hold a byte-level vocabulary without normalizer and prefix space")
    alphabet = byte_alphabet()
    raw = lambda token: bytes(alphabet[c] for c in token)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
    added = {}
    for x in file.get("added_tokens", []):
        if x["lstrip"] or x["rstrip"] or x["single_word"]:
            raise ValueError(f"added token {x['content']!r} has options that are not supported")
        added[x["content"].encode()] = x["id"]
    return {raw(t): i for t, i in file["model"]["vocab"].items() if t.encode() not in added}, [(raw(a), raw(b)) for a, b in merges], added


class Backtracking(Codec):
    """Encodes and decodes texts; chunks are kept and looked up as in Codec, new matches are encoded by backtracking."""

    def __init__(self, data: bytes, special: bool = True):
        import ahocorasick
        import regex

        vocabulary, merges, added = read_vocabulary(data)
        tokens = [b""] * (max((vocabulary | added).values()) + 1)
        for token, i in (vocabulary | added).items():
            tokens[i] = token
        self._set_up(tokens, BLANKS_BEGIN)
        self.of_byte = np.array([vocabulary.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.ranks = {bytes([i]): vocabulary[bytes([i])] for i in range(256) if bytes([i]) in vocabulary}
        self.halves, self.made, self.merge = {}, dict.fromkeys(self.ranks.values(), -1), {}
        for rank, (a, b) in enumerate(merges):
            i, k = vocabulary[a], vocabulary[b]
            whole = vocabulary[a + b]
            self.merge.setdefault((i, k), rank)
            if whole not in self.made:
                self.ranks[a + b], self.halves[whole], self.made[whole] = whole, (i, k), rank
        self.shorter = {i: next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), None) for t, i in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.added = added if special else {}
        self.find_added = regex.compile(b"|".join(regex.escape(t, literal_spaces=True) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two neighbouring tokens."""
        x, y, until = left, right, _NEVER
        while True:
            # x and y stand side by side until a merge of rank below `until` takes one of them
            if self.merge.get((x, y), _NEVER) < until:
                return False
            mx, my = self.made[x], self.made[y]
            if mx > my:
                x, until = self.halves[x][1], mx  # of equal ranks the left one comes first
            elif my >= 0:
                y, until = self.halves[y][0], my + 1
            else:
                return True

    def _fits(self, key: int) -> bool:
        """compatible() of a pair, left * base + right, that is not in the table yet."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[key] = self.compatible(*divmod(key, self.base))
        return found

    def backtrack(self, longest: list[int], begin: int, end: int) -> list[int]:
        """Ids of the match at begin..end; longest: the longest token that begins at each place."""
        dead, out, at, sizes, shorter, known, base = set(), [], begin, self.token_sizes, self.shorter, self.pairs.get, self.base
        token, left = longest[at], -1  # left: the token before, times base
        while True:
            stop = at + sizes[token]
            if stop <= end and stop not in dead:
                fits = left < 0 or known(left + token)
                if fits or fits is None and self._fits(left + token):
                    out.append(token)
                    if stop == end:
                        return out
                    at, left, token = stop, token * base, longest[stop]
                    continue
            token = shorter[token]
            while token is None:  # no token fits here
                dead.add(at)
                last = out.pop()
                at -= sizes[last]
                left = out[-1] * base if out else -1
                token = shorter[last]

    def _encode_raw(self, raw: list[bytes]) -> Iterator[list[int]]:
        """Ids of matches; one pass of the automaton over all of them. The separator is in no token."""
        joined = "Ā".join(x.decode("latin-1") for x in raw)
        last = len(joined) - 1
        longest, seen, at = [0] * len(joined), -1, 0
        for i, token in self.automaton.iter(joined[::-1]):
            if i != seen:  # of the tokens that begin at a place the longest comes first
                longest[last - i], seen = token, i
        for x in raw:
            yield self.backtrack(longest, at, at + len(x))
            at += len(x) + 1

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        index = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        which = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        raw = [p.encode() for p in index]
        whole = self.ranks.get
        found = [[i] if (i := whole(x)) is not None else None for x in raw]
        new, size = [], 0
        for k, ids in enumerate(found):
            if ids is None:
                new.append(k)
                size += len(raw[k])
            if new and (size > 1 << 18 or k == len(found) - 1):
                for j, ids in zip(new, self._encode_raw([raw[j] for j in new]), strict=True):
                    found[j] = ids
                new, size = [], 0
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, count.sum())
        return gather(flat, (np.cumsum(count) - count)[which], count[which]), count[which]

    def encode_all(self, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        spans = self._added_spans(b, at)
        if not spans:
            return super().encode_all(b, at)
        cuts = np.unique(np.array([x for a, z, _ in spans for x in (a, z)], np.int64))
        fine = np.sort(np.concatenate([at, np.setdiff1d(cuts, at)]))
        ids, offsets, back, _ = super().encode_all(b, fine)
        first = np.searchsorted(fine, [a for a, _, _ in spans], side="right") - 1  # the part that is the added token
        counts = np.diff(offsets)
        keep = np.ones(len(ids), bool)
        for i in first.tolist():
            keep[offsets[i] + 1:offsets[i + 1]] = False
        ids[offsets[first]] = [x for _, _, x in spans]
        counts[first] = 1
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids[keep], total[np.searchsorted(fine, at)], back, at - at[0]

    def _added_spans(self, b: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """Begin, end and id of the added tokens in each text."""
        if self.find_added is None:
            return []
        data = b.tobytes()
        if not any(t in data for t in self.added):
            return []
        return [(a + m.start(), a + m.end(), self.added[m.group()]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for m in self.find_added.finditer(data[a:z])]


_CODECS: dict[int, Backtracking] = {}


def codec(data: bytes, special: bool = True) -> Backtracking:
    """One codec a worker process and file, so its tables live on from task to task."""
    key = hash((data, special))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Backtracking(data, special)
    return _CODECS[key]


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def backtrack_round_trip(df: DataFrame, text: str, key: str, path: str, packed: bool = False, special: bool = True) -> DataFrame:
    """key, ids and decoded (the bytes that the ids give back) of every whole text.

    ids are array<int>, or if packed a binary of little-endian unsigned 32-bit numbers, as token
    files hold them. special: whether strings of added tokens in texts are these tokens. The driver
    reads the vocabulary file, of fixed size, and broadcasts its bytes.
    """
    if key in ("ids", "decoded"):
        raise ValueError(f"the key column may not be named {key}")
    data = df.sparkSession.sparkContext.broadcast(file_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value, special)
        for batch in batches:
            for part in steps(batch, "_text", 1 << 20):
                ids, offsets, decoded, ends = own.encode_all(*text_bytes(part["_text"]))
                rows = [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
                coded = pa.BinaryArray.from_buffers(pa.binary(), len(part), rows) if packed else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                back = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(decoded))])
                yield pa.RecordBatch.from_arrays([part["_key"], coded, back], ["_key", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(lean(run), f"_key {kind}, ids {'binary' if packed else 'array<int>'}, decoded binary").withColumnRenamed("_key", key)


def backtrack_decode(df: DataFrame, ids: str, key: str, path: str) -> DataFrame:
    """key and decoded bytes of an array<int> column; null gives no bytes. An id outside the vocabulary is an error."""
    data = df.sparkSession.sparkContext.broadcast(file_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["_key"], pa.array([own.decode(np.array(x or [], np.int64)).tobytes() for x in batch["_ids"].to_pylist()], pa.binary())], ["_key", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(lean(run), f"_key {kind}, decoded binary").withColumnRenamed("_key", key)


def backtrack_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, for each row of docs."""
    return backtrack_round_trip(docs, "text", "doc_id", path, packed=True).select(
        "doc_id", F.expr("cast(octet_length(ids) DIV 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )

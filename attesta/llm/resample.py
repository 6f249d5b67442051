"""Importance resampling towards a target: draw documents whose words are as the target's.

Features of a text are its runs of 1 to max_words consecutive words (A-Z lower-cased; letters, digits
and all characters beyond ASCII), repeats counted. A feature's bucket is the CRC-32 of its bytes
modulo the number of buckets; a bucket's gain is 1000 times the log ratio of its smoothed shares in
target and corpus, rounded down.

1. Each task puts the features of its texts into a trie of words. A node is a feature; it holds the
   feature's count and its CRC state, from which the states of its children go on, so a word's bytes
   are read once a node. Where a trie gets NODES nodes, its counts are added to the task's bucket
   totals and a new one is begun: memory is bounded and nothing is lost.
2. The tasks' bucket totals are summed; these are n_buckets rows, and the driver makes the gains.
3. Each task walks its texts through a trie whose nodes have their bucket's gain attached. A document's
   weight is the floored mean of its gains, its score adds Gumbel noise from a hash of seed and id.
4. Documents are dealt by ranges of (enough words, score, id), numbered in each range and moved on by
   the ranges before, so no task orders them all. The best percent of those with enough words are drawn.

Null texts have no words. Documents without features weigh 0. A null id hashes as an empty one and
comes after other ids of its score. Rows that repeat an id are documents of their own with the same
noise; ties of score and id go by features, weight, and order of the input. Texts are never cut.
Other columns, of any name, are left out. An empty corpus gives no rows; with an empty target every
gain is that of absent words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.arrays import lean, steps
from attesta.session import materialize

#: Nodes of a trie; of about 0.3 KB each.
NODES = 150_000
#: Rows that one task orders.
RANGE_ROWS = 250_000
#: What parts words becomes a blank, A-Z becomes a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class Node(dict):
    """A feature; its items are the features that go on with one more word."""

    __slots__ = ("crc", "value", "trie")

    def __init__(self, trie: Trie, crc: int, value: int):
        self.trie, self.crc, self.value = trie, crc, value

    def __missing__(self, word: bytes) -> Node:
        trie = self.trie
        crc = zlib.crc32(b" " + word, self.crc) if self is not trie.root else zlib.crc32(word)
        trie.size += 1
        child = self[word] = Node(trie, crc, 0 if trie.gains is None else trie.gains[crc % len(trie.gains)])
        return child


class Trie:
    """Runs of words. value of a node: its count, or with gains the gain of its bucket."""

    def __init__(self, gains: list[int] | None = None):
        self.gains, self.size = gains, 0
        self.root = Node(self, 0, 0)

    def add(self, texts: list[list[bytes]], max_words: int) -> None:
        for n in range(1, max_words + 1):
            runs = Counter()
            for words in texts:
                runs.update(words if n == 1 else zip(*(words[k:] for k in range(n)), strict=False))
            for run, count in runs.items():
                node = self.root
                for word in (run,) if n == 1 else run:
                    node = node[word]
                node.value += count

    def total(self, words: list[bytes], max_words: int) -> int:
        """Sum of the gains of a text's features."""
        root, out = self.root, 0
        if max_words == 1:
            for word in words:
                out += root[word].value
            return out
        for i in range(len(words)):
            node = root
            for word in words[i:i + max_words]:
                node = node[word]
                out += node.value
        return out

    def drain(self, n_buckets: int) -> np.ndarray:
        """Counts by bucket; the trie is empty then."""
        out, left = np.zeros(n_buckets, np.int64), list(self.root.values())
        while left:
            node = left.pop()
            out[node.crc % n_buckets] += node.value
            left.extend(node.values())
        self.clear()
        return out

    def clear(self) -> None:
        self.root.clear()
        self.size = 0


def feature_count(words: int, max_words: int) -> int:
    return sum(max(0, words - n) for n in range(max_words))


def bucket_totals(df: DataFrame, text: str, max_words: int, n_buckets: int) -> DataFrame:
    """bucket and n, the features of all texts in it; buckets without features are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for part in steps(batch, "_text", 1 << 20):
                trie.add([words_of(x or b"") for x in part["_text"].cast(pa.binary()).to_pylist()], max_words)
                if trie.size > NODES:
                    totals += trie.drain(n_buckets)
        totals += trie.drain(n_buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["bucket", "n"])

    return df.select(F.col(text).alias("_text")).mapInArrow(lean(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, n_buckets: int) -> list[int]:
    """The gain of each bucket from bucket totals, which have at most n_buckets rows."""
    s, t = ({r["bucket"]: r["n"] for r in x.collect()} for x in (corpus, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + n_buckets) / ((s.get(b, 0) + 1) * (all_t + n_buckets)))) for b in range(n_buckets)]


def weigh(df: DataFrame, text: str, key: str, gains: list[int], max_words: int) -> DataFrame:
    """key, n_words, n_features and weight of each row."""
    shared = df.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            for part in steps(batch, "_text", 1 << 20):
                found = []
                for raw in part["_text"].cast(pa.binary()).to_pylist():
                    words = words_of(raw or b"")
                    n = feature_count(len(words), max_words)
                    found.append((len(words), n, trie.total(words, max_words) // n if n else 0))
                    if trie.size > NODES:
                        trie.clear()
                yield pa.RecordBatch.from_arrays([part["_key"], *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], ["_key", "n_words", "n_features", "weight"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(lean(run), f"_key {kind}, n_words bigint, n_features bigint, weight bigint")


def importance_resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", max_words: int = 1, n_buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024") -> DataFrame:
    """key, n_words, n_features, weight, score and rank of each row of docs; rank is null for those that aren't drawn.

    target has a column of the name of `text` too.
    """
    if key in ("n_words", "n_features", "weight", "score", "rank"):
        raise ValueError(f"the key column may not be named {key}")
    gains = bucket_gains(bucket_totals(docs, text, max_words, n_buckets), bucket_totals(target, text, max_words, n_buckets), n_buckets)
    share = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((share + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weigh(docs, text, key, gains, max_words).withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id())
    scored = materialize(scored.withColumn("_enough", (F.col("n_words") >= min_words).cast("int")), "resample-scores")
    rows, enough = scored.agg(F.count("*"), F.coalesce(F.sum("_enough"), F.lit(0))).first()
    order = [F.desc("_enough"), F.desc("score"), F.asc_nulls_last("_key"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]
    ranged = materialize(scored.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), *order).withColumn("_range", F.spark_partition_id()), "resample-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    out = ranged.join(offsets, "_range").withColumn("_place", place)
    rank = F.when((F.col("_enough") == 1) & (F.col("_place") <= F.lit(percent * enough // 100)), F.col("_place").cast("bigint"))
    return out.select(F.col("_key").alias(key), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key was drawn; same columns. Rows with a null key stay out."""
    name = "_drawn"
    while name in docs.columns:
        name += "_"
    keys = ranked.where("rank IS NOT NULL").select(F.col(key).alias(name)).distinct()
    return docs.join(keys, docs[key] == keys[name], "left_semi")


def resample_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank with runs of one word, 10,000 buckets, a tenth of the documents of 20 words or more."""
    return importance_resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: The same in SQL; CRC-32 from a table of 256 entries that follows from its polynomial.
REPORT_SQL = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(list_prepend(CAST(n AS UBIGINT), list_transform(range(8), lambda k: CAST(k AS UBIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS n)
  )
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), counted AS (
  SELECT word, sum(s) AS s, sum(t) AS t FROM (
    SELECT unnest(words) AS word, 1 AS s, 0 AS t FROM d UNION ALL SELECT unnest(words), 0, 1 FROM b
  ) GROUP BY word
), hashed AS (
  SELECT word, s, t, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(octet_length(encode(word))), lambda i: CAST(concat('0x', substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2)) AS UBIGINT))),
    lambda c, x: xor(c >> 8, tab[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket
  FROM counted, crc_table
), totals AS (
  SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000) / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS BIGINT) AS gain FROM totals
), of_word AS (
  SELECT word, gain FROM hashed JOIN gains USING (bucket)
), weighed AS (
  SELECT doc_id, CAST(len(any_value(d.words)) AS BIGINT) AS n_features, CAST(coalesce(sum(gain), 0) AS BIGINT) AS total
  FROM d LEFT JOIN (SELECT doc_id AS id, unnest(words) AS word FROM d) w ON w.id = d.doc_id LEFT JOIN of_word USING (word) GROUP BY doc_id
), scored AS (
  SELECT doc_id, n_features, CASE WHEN n_features = 0 THEN 0 ELSE CAST((total - ((total % n_features) + n_features) % n_features) // n_features AS BIGINT) END AS weight,
         CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS UBIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM weighed
), ordered AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ordered
"""

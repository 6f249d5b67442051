"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Test texts are cut into windows of 10 words. The corpus is read once to count the test terms, which
ranks each window's terms by rarity; windows with a term that the corpus lacks are out. A second
read stores the index: the postings (term, document, position) of the rarest terms, as a table.
Intersecting the postings of a window's two rarest terms, each less its offset in the window, gives
candidate starts, and the words at a candidate start are compared with the window (by sha256 of the
phrase). What is kept of a document's candidates is bounded by its own length.

Documents are told by the sha256 of their text while matching, so copies share their postings and null
or repeated ids do no harm. Null texts have no words. An item without words matches nothing; one of
fewer than 10 words is one window. Rows of docs stay one for one, and other columns play no part.
Small sides are broadcast if a count finds few rows; beyond that, joins on terms are salted, so that
the postings of one very common term are dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.session import materialize

WINDOW = 10
RAREST = 2
#: Fixed value: what parts words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same characters one by one, less A-Z, which are lower-cased first.
PARTING = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Tables of at most this many rows are broadcast (tens of MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Parts that the postings of a term are dealt to where terms are joined by a shuffle.
SALTS = 32


def words_of(text: Column) -> Column:
    """Words of a text, by two passes without regular expressions."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + PARTING, LOWER + " " * len(PARTING))
    return F.array_remove(F.split(spaced, " "), "")


def text_id(text: Column) -> Column:
    """32 bytes that stand for a text; null for null. No two texts with one sha256 are known, as they are for shorter hashes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def phrase_id(words: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(" ", words).cast("binary"), 256))


def checked_broadcast(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, to be broadcast if a count finds at most limit rows. df should be materialised."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if limit is None else limit) else df


def join_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Inner join on term, of many postings with a table of terms; a term's postings are salted where terms are too many to broadcast."""
    if terms.count() <= BROADCAST_ROWS:
        return postings.join(F.broadcast(terms), "term")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    dealt = terms.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return postings.withColumn("_salt", salt).join(dealt, ["term", "_salt"]).drop("_salt")


def test_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, words and phrase of every window of every item."""
    words = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).withColumn("phrase", phrase_id(F.col("words")))


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """term and n: how often each of terms (column term) is in the whole corpus; absent ones have no row."""
    return join_terms(docs.select(F.explode(words_of(F.col(text))).alias("term")), terms).groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """The inverted index of terms (column term): term, doc (text_id) and position from 0."""
    named = docs.select(text_id(F.col(text)).alias("doc"), words_of(F.col(text)).alias("w"))
    return join_terms(named.select("doc", F.posexplode("w").alias("position", "term")), terms).select("term", "doc", "position")


def rarest_terms(windows: DataFrame, counts: DataFrame, k: int = RAREST) -> DataFrame:
    """window, length, term, shift, turn (from 0, by rarity) and k: the k rarest places of each window whose terms all occur."""
    places = windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("shift", "term")).join(counts, "term", "left")
    of_window = Window.partitionBy("window")
    ranked = places.withColumn("known", F.count("n").over(of_window)).where(F.col("known") == F.col("length")).withColumn("turn", F.row_number().over(of_window.orderBy("n", "shift")) - 1)
    return ranked.where(F.col("turn") < k).select("window", "length", "term", "shift", "turn", F.least(F.lit(k), "length").alias("k"))


def phrase_candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc, window and start where the anchors' postings, each less its shift, meet."""
    shifted = join_terms(index, anchors).select("doc", "window", (F.col("position") - F.col("shift")).alias("start"), F.expr("shiftleft(1, turn)").alias("bit"), F.expr("shiftleft(1, k) - 1").alias("all")).where("start >= 0")
    met = shifted.groupBy("doc", "window", "start").agg(F.bit_or("bit").alias("met"), F.first("all").alias("all"))
    return met.where("met = all").select("doc", "window", "start")


def build_index(docs: DataFrame, benchmark: DataFrame, text: str, size: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The stored index, its anchors, the different windows (window, phrase, words) and all windows (item_id, words, phrase)."""
    every = materialize(test_windows(benchmark, size), "decontaminate-windows")
    windows = materialize(every.select("phrase", "words").dropDuplicates(["phrase"]).withColumn("window", F.monotonically_increasing_id()), "decontaminate-phrases")
    terms = materialize(windows.select(F.explode("words").alias("term")).distinct(), "decontaminate-terms")
    anchors = materialize(rarest_terms(windows, term_counts(docs, terms, text), k), "decontaminate-anchors")
    rare = materialize(anchors.select("term").distinct(), "decontaminate-rare")
    return materialize(postings(docs, rare, text), "decontaminate-index"), anchors, windows, every


def phrase_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Exact matches (doc, phrase, length, start; rows of copies repeat), and the windows (item_id, words, phrase)."""
    index, anchors, windows, every = build_index(docs, benchmark, text, size, RAREST)
    named = windows.select("window", "phrase", F.size("words").alias("length"))
    met = phrase_candidates(index, anchors).join(checked_broadcast(named), "window")
    found = materialize(met.groupBy("doc").agg(F.collect_list(F.struct("start", "length", "phrase")).alias("found")), "decontaminate-candidates")
    own = docs.select(text_id(F.col(text)).alias("doc"), F.col(text).alias("text"))
    asked = own.join(checked_broadcast(found, 20_000), "doc").select("doc", words_of(F.col("text")).alias("w"), "found")
    true = F.filter("found", lambda c: phrase_id(F.slice(F.col("w"), c["start"] + 1, c["length"])) == c["phrase"])
    return asked.select("doc", F.explode(true).alias("c")).select("doc", "c.phrase", "c.length", "c.start"), every


def proximity_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, slop: int = 3, k: int = 3) -> DataFrame:
    """doc, phrase and start where the k rarest terms of a window stand in its order, shifted by at most slop words in all.

    Found from the stored postings alone, which are dealt once, by document. There the places of a window's anchors, each less its shift, are ordered,
    and each one of the first anchor looks over those within slop for the other anchors, which must stand behind it: one whose shift is
    greater by d may be at most d - 1 earlier than expected. A place looks over at most k * (2 * slop + 1) others.
    """
    index, anchors, windows, _ = build_index(docs, benchmark, text, size, k)
    of_window = Window.partitionBy("window")
    order = F.row_number().over(of_window.orderBy("shift"))
    bit = F.when(order > 1, F.call_function("shiftleft", F.lit(1), order - 2))
    reach = F.least(F.lit(slop), F.col("shift") - F.min("shift").over(of_window) - 1)
    anchors = materialize(anchors.select("window", "term", "shift", "k", bit.alias("bit"), reach.alias("reach")), "decontaminate-ordered")
    at = join_terms(index.distinct().repartition("doc"), anchors).select("doc", "window", "k", "bit", "reach", (F.col("position") - F.col("shift")).alias("start"))
    places = Window.partitionBy("doc", "window").orderBy("start")
    seen = F.lit(0)
    for early in range(slop + 1):
        seen = seen.bitwiseOR(F.coalesce(F.bit_or(F.when(F.col("reach") == early, F.col("bit"))).over(places.rangeBetween(-early, slop)), F.lit(0)))
    met = at.withColumn("seen", seen).where("bit IS NULL AND seen = shiftleft(1, k - 1) - 1")
    return met.join(checked_broadcast(windows.select("window", "phrase")), "window").select("doc", "phrase", "start")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc, n_hit, n_items and items_sha256 of each different text with a match."""
    matches, windows = phrase_matches(docs, benchmark, text)
    matches = materialize(matches, "decontaminate-matches")
    before = Window.partitionBy("doc").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = matches.select("doc", "start", "length").distinct().withColumn("reached", F.max(end).over(before))
    hit = spans.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("reached", "start")))).cast("bigint").alias("n_hit"))
    named = matches.select("doc", "phrase").distinct().join(checked_broadcast(windows.select("item_id", "phrase")), "phrase").select("doc", F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items")).select("doc", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return hit.join(items, "doc")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs."""
    found = materialize(contamination(docs, benchmark), "decontaminate-found")
    named = docs.select("doc_id", text_id(F.col("text")).alias("doc"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    return named.join(checked_broadcast(found), "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def proximity_report(docs: DataFrame, benchmark: DataFrame, slop: int = 3, k: int = 3) -> DataFrame:
    """doc_id, n_near (places where a window's rarest terms stand near each other), n_near_items and near_items_sha256 for each row of docs.

    Rows of docs stay one for one. Null texts and texts without words have no places; items with a word that the corpus lacks are near nothing.
    An exact match is a near one too. Copies and repeated rows have equal values; other columns play no part.
    """
    near = materialize(proximity_matches(docs, benchmark, slop=slop, k=k), "decontaminate-near")
    phrases = materialize(test_windows(benchmark).select("phrase", F.col("item_id").cast("string").alias("item")).distinct(), "decontaminate-near-items")
    places = near.groupBy("doc").agg(F.count_distinct("start").alias("n_near"))
    named = near.select("doc", "phrase").distinct().join(checked_broadcast(phrases), "phrase")
    items = named.groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items")).select("doc", F.size("items").cast("bigint").alias("n_near_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("near_items_sha256"))
    found = materialize(places.join(items, "doc"), "decontaminate-near-found")
    own = docs.select("doc_id", text_id(F.col("text")).alias("doc"))
    return own.join(checked_broadcast(found), "doc", "left").select(
        "doc_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_near", "n_near_items")), F.coalesce("near_items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("near_items_sha256")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs whose text holds no window of the benchmark; same columns."""
    name = "_found"
    while name in docs.columns:
        name += "_"
    found = materialize(contamination(docs, benchmark, text).select(F.col("doc").alias(name)), "decontaminate-found")
    return docs.join(checked_broadcast(found), text_id(docs[text]) == F.col(name), "left_anti")


REPORT_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), grams AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (
  SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.phrase = x.phrase AND g.size = x.size
), cells AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       coalesce(t.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cells c ON c.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id"""


PROXIMITY_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), phrases AS (
  SELECT DISTINCT words, len(words) AS length FROM windows
), postings AS (
  SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS position FROM d WHERE len(w) > 0
), counts AS (
  SELECT term, count(*) AS n FROM postings GROUP BY term
), places AS (
  SELECT words, length, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS shift FROM phrases
), ranked AS (
  SELECT words, length, term, shift, count(n) OVER (PARTITION BY words) AS known, row_number() OVER (PARTITION BY words ORDER BY n, shift) AS turn FROM places LEFT JOIN counts USING (term)
), anchors AS (
  SELECT words, term, shift, least(3, length) AS k, row_number() OVER (PARTITION BY words ORDER BY shift) AS place FROM ranked WHERE known = length AND turn <= 3
), met AS (
  SELECT doc_id, words, k, place, position, position - shift AS start FROM postings JOIN anchors USING (term)
), near AS (
  SELECT h.doc_id, h.words, h.start FROM (SELECT * FROM met WHERE place = 1) h
  LEFT JOIN (SELECT * FROM met WHERE place > 1) r ON h.doc_id = r.doc_id AND h.words = r.words AND abs(r.start - h.start) <= 3 AND r.position > h.position
  GROUP BY h.doc_id, h.words, h.start, h.k HAVING count(DISTINCT r.place) = h.k - 1
), starts AS (
  SELECT doc_id, count(DISTINCT start) AS n FROM near GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM near JOIN windows USING (words)) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_near, coalesce(i.n, 0) AS n_near_items, coalesce(i.items, sha256('')) AS near_items_sha256
FROM d LEFT JOIN starts s ON s.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id"""

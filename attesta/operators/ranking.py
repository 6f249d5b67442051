"""Ranked retrieval: keyword (BM25), trigram and vector scores, fusion and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions.stem import stemmed
from attesta.functions.text import tokens, trigrams
from attesta.session import materialize


def top_k(scored: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank; give order a unique last key. Spark limits each group before the shuffle."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def postings(chunks: DataFrame, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """term, key, tf and dl (tokens of the chunk)."""
    words = chunks.select(key, tokens(F.col(text)).alias("w"))
    return words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


#: Tables of at most this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, to be broadcast if a count finds at most limit rows."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if limit is None else limit) else df


def bm25(asked: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75, on: list[str] | None = None, seen: Column | None = None, stems: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id and score of chunks that hold a term of the question (column question). Statistics are those of chunks.

    Only the questions' terms are counted: they are joined to the exploded words before anything is grouped. With on and seen, questions and
    chunks meet only where these columns of both are equal and the condition (over columns of either) holds; the result then has the columns of
    on too, and asked may have several rows for a question. With stems (term, stem) words count as their stems. Sums are partial before the shuffle.
    """
    keys = on or []
    terms = asked.select("query_id", *[c for c in asked.columns if c not in ("query_id", "question")], F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    own = [c for c in chunks.columns if c not in ("chunk_id", "text")] if keys else []
    words = chunks.select("chunk_id", *own, tokens(F.col("text")).alias("w"))
    stats = words.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("w")).alias("avgdl"))
    if stems is None:
        wanted = terms.select("term", F.col("term").alias("stem")).distinct()
    else:
        terms = terms.join(stems, "term").drop("term").withColumnRenamed("stem", "term").distinct()
        wanted = stems.join(small(terms.select(F.col("term").alias("stem")).distinct()), "stem", "left_semi")
    held = words.select("chunk_id", *own, F.size("w").alias("dl"), F.explode("w").alias("term")).join(small(wanted), "term").drop("term").withColumnRenamed("stem", "term")
    tf = held.groupBy("term", "chunk_id", "dl", *own).agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    known = small(df).crossJoin(F.broadcast(stats))
    scored = tf.join(known, "term").select("term", "chunk_id", *own, (idf * weight).alias("part"))
    met = meet(scored, terms, ["term", *keys], "chunk_id")
    return (met if seen is None else met.where(seen)).groupBy("query_id", *keys, "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))


#: A side too large to be broadcast is copied to so many salts, and the other side's rows of a key are dealt to them.
SALTS = 16


def meet(rows: DataFrame, asked: DataFrame, on: list[str], deal: str) -> DataFrame:
    """rows joined with asked. If asked is small it is broadcast; else both are salted, as one key may hold a large share of rows. deal: a column of rows that spreads a key's rows."""
    if asked.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(asked), on)
    salted = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def question_terms(asked: DataFrame) -> DataFrame:
    """query_id, n (distinct terms of the question), i (0 to n - 1) and term."""
    terms = asked.select("query_id", F.array_distinct(tokens(F.col("question"))).alias("q")).where(F.size("q") > 0)
    return terms.select("query_id", F.size("q").alias("n"), F.posexplode("q").alias("i", "term"))


def positional_postings(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """term, chunk_id, dl and at (ascending positions, from 0 on) of the terms asked for; other words are dropped before anything is grouped."""
    words = chunks.select("chunk_id", tokens(F.col("text")).alias("w"))
    held = words.select("chunk_id", F.size("w").alias("dl"), F.posexplode("w").alias("position", "term")).join(small(terms.select("term").distinct()), "term", "left_semi")
    return held.groupBy("term", "chunk_id", "dl").agg(F.sort_array(F.collect_list("position")).alias("at"))


def full_text(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, exact (the chunk holds every term of the question) and density: a tenth of the terms' occurrences, by the chunk's length.

    That is the cover density of the question's terms joined by OR, whose covers are single words. Rank by exact, then density.
    """
    terms = question_terms(asked)
    found = positional_postings(chunks, terms).select("term", "chunk_id", "dl", F.size("at").alias("tf"))
    met = meet(found, terms, ["term"], "chunk_id").groupBy("query_id", "chunk_id", "dl", "n").agg(F.count("*").alias("met"), F.sum("tf").alias("hits"))
    return met.select("query_id", "chunk_id", (F.col("met") == F.col("n")).alias("exact"), F.round(0.1 * F.col("hits") / F.col("dl"), 9).alias("density"))


def minimal_covers(occurrences: Column, n: Column) -> Column:
    """The shortest intervals that hold all n terms: an array of structs of l and r, by ascending l.

    occurrences: array of structs (position, i) in order. One sweep keeps the last position of each term; the earliest of these is where
    an interval that ends here must begin, and of the intervals with one beginning the first is the shortest.
    """
    cover = "array<struct<l:int,r:int>>"
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.array().cast(cover).alias("covers"))

    def step(state: Column, x: Column) -> Column:
        last = F.transform(state["last"], lambda p, i: F.when(i == x["i"], x["position"]).otherwise(p))
        left = F.array_min(last)
        new = (left >= 0) & (F.coalesce(F.try_element_at(state["covers"], F.lit(-1))["l"], F.lit(-1)) < left)
        return F.struct(last.alias("last"), F.when(new, F.concat(state["covers"], F.array(F.struct(left.alias("l"), x["position"].alias("r"))))).otherwise(state["covers"]).alias("covers"))

    return F.aggregate(occurrences, start, step)["covers"]


def cover_density(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, exact, covers, cover and density.

    covers counts the minimal intervals of the chunk that hold all terms of the question; each adds 0.1 / (1 + words in it that aren't
    terms) to cover, which is divided by 1 + ln(words of the chunk). Chunks that lack a term have no covers; exact and density are
    those of full_text. Rank by exact, cover, density.
    """
    terms = question_terms(asked)
    met = meet(positional_postings(chunks, terms), terms, ["term"], "chunk_id").groupBy("query_id", "chunk_id", "dl", "n").agg(F.collect_list(F.struct("i", "at")).alias("found"), F.sum(F.size("at")).alias("hits"))
    exact = F.size("found") == F.col("n")
    flat = F.array_sort(F.flatten(F.transform(F.when(exact, F.col("found")).otherwise(F.array().cast("array<struct<i:int,at:array<int>>>")), lambda f: F.transform(f["at"], lambda p: F.struct(p.alias("position"), f["i"].alias("i"))))))
    swept = met.withColumn("exact", exact).withColumn("flat", flat).withColumn("c", minimal_covers(F.col("flat"), F.col("n")))
    noise = lambda c: c["r"] - c["l"] + 1 - F.size(F.filter("flat", lambda x: (x["position"] >= c["l"]) & (x["position"] <= c["r"])))
    total = F.aggregate(F.transform("c", lambda c: 0.1 / (1 + noise(c))), F.lit(0.0), lambda a, x: a + x)
    return swept.select("query_id", "chunk_id", "exact", F.size("c").alias("covers"), F.round(total / (1 + F.log("dl")), 9).alias("cover"), F.round(0.1 * F.col("hits") / F.col("dl"), 9).alias("density"))


def word_stems(texts: DataFrame, column: str) -> DataFrame:
    """term and stem of each distinct word of a column, stored."""
    words = texts.select(F.explode(tokens(F.col(column))).alias("term")).distinct()
    return materialize(stemmed(words, "term"), "word-stems")


def stemmed_bm25(asked: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """bm25 over Porter stems. Distinct words are stemmed, each once; of the chunks' words only those whose stem is asked for go on."""
    stems = word_stems(asked.select(F.col("question").alias("t")).unionByName(chunks.select(F.col("text").alias("t"))), "t")
    return bm25(asked, chunks, stems=stems, **options)


def ordered_sets(sets: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """keys and r, the ascending ranks of a set's trigrams; rare trigrams have small ranks. Sets (column g) without a ranked trigram are left out.

    ranks has a row for each trigram of [a-z0-9] and blanks, 50,653 at most, so it is broadcast.
    """
    each = sets.select(*keys, F.explode("g").alias("t")).join(F.broadcast(ranks), "t")
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list("rank")).alias("r"))


#: By what share of a set its prefix is longer than it must be: more rows meet, but their number tells far better which pairs can be similar.
LONGER = 0.15


def _prefix(r: Column, share: Column) -> Column:
    """The first (rarest) members of a set that one looks at: among the shortest of these, each set with at least this similarity has a member."""
    n = F.size(r)
    return F.slice(r, 1, F.greatest(F.lit(1), F.least(n, n - F.ceil(share * n - 1e-9) + 1 + F.floor(LONGER * n))).cast("int"))


def prefix_candidates(queries: DataFrame, items: DataFrame, share: Column, floor: float) -> DataFrame:
    """query_id, section_id and f of pairs whose Jaccard similarity may reach a share of the query's; queries and items have r, their sets in one common order.

    Sizes must fit. What both prefixes share is counted; what else the sets may share is in one of them beyond its prefix, namely in the
    one whose prefix ends earlier. Pairs that can't get enough members by that are dropped before any set is looked at.
    """
    q = queries.select("query_id", F.size("r").alias("qn"), share.alias("t"), _prefix(F.col("r"), share).alias("p")).select("query_id", "qn", "t", F.size("p").alias("qp"), F.array_max("p").alias("qe"), F.explode("p").alias("x"))
    i = items.select("section_id", "f", F.size("r").alias("kn"), _prefix(F.col("r"), F.lit(floor)).alias("p")).select("section_id", "f", "kn", F.size("p").alias("kp"), F.array_max("p").alias("ke"), F.explode("p").alias("x"))
    fits = (F.col("t") * F.col("kn") <= F.col("qn") + 1e-6) & (F.col("t") * F.col("qn") <= F.col("kn") + 1e-6)
    met = meet(i, q, ["x"], "section_id").where(fits).groupBy("query_id", "section_id", "f", "qn", "kn", "qp", "kp", "qe", "ke", "t").agg(F.count("*").alias("m"))
    most = F.col("m") + F.when(F.col("qe") <= F.col("ke"), F.col("qn") - F.col("qp")).otherwise(F.col("kn") - F.col("kp"))
    return met.where(most * (1 + F.col("t")) >= F.col("t") * (F.col("qn") + F.col("kn")) - 1e-6).select("query_id", "section_id", "f")


def _similar(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, section_id and sim (of the more similar of its texts) of pairs."""
    both = pairs.join(items, ["section_id", "f"]).join(small(queries.select("query_id", F.col("r").alias("qr"))), "query_id")
    shared = F.size(F.array_intersect("r", "qr"))
    return both.withColumn("m", shared).groupBy("query_id", "section_id").agg(F.round(F.max(F.col("m") / (F.size("r") + F.size("qr") - F.col("m"))), 6).alias("sim"))


def trigram_search(asked: DataFrame, sections: DataFrame, floor: float = 0.2, k: int = 10, counted: dict | None = None) -> DataFrame:
    """query_id, section_id, sim and rank: the k sections whose key or heading is most like the question (column question), above the floor.

    sections: section_id, key, heading. A set-similarity join by prefixes, in two rounds. The first looks only at texts that meet a question's
    set among the rarest trigrams of both, and so finds the most similar ones if they are very similar; the k-th of these is a bound from below. The second asks for all that
    may reach the bound: with trigrams ordered from rare to common, such sets share one among the first of both, and the higher the bound the
    fewer are looked at. Similarities are exact, and ties at the k-th place are all met. counted, if given, gets the pairs of the second round.
    """
    texts = F.array(F.struct(F.lit(0).alias("f"), F.col("key").alias("t")), F.struct(F.lit(1).alias("f"), F.coalesce("heading", F.lit("")).alias("t")))
    named = sections.select("section_id", F.explode(texts).alias("x")).select("section_id", "x.f", trigrams(F.col("x.t")).alias("g"))
    named = materialize(named.where(F.size("g") > 0), "trigram-sets")
    seen = named.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    ranks = materialize(seen.select("t", F.row_number().over(Window.orderBy("n", "t")).alias("rank")), "trigram-ranks")
    items = materialize(ordered_sets(named, ["section_id", "f"], ranks), "trigram-items")
    sets = asked.select("query_id", trigrams(F.col("question")).alias("g"))
    # trigrams that no section has come first, as the rarest
    none = -F.size(F.array_except("g", F.coalesce("known", F.array().cast("array<string>"))))
    known = sets.select("query_id", F.explode("g").alias("t")).join(F.broadcast(ranks.select("t")), "t").groupBy("query_id").agg(F.collect_list("t").alias("known"))
    missing = sets.join(known, "query_id", "left").select("query_id", none.alias("absent"))
    queries = ordered_sets(sets, ["query_id"], ranks).join(missing, "query_id").select("query_id", F.concat(F.transform(F.when(F.col("absent") < 0, F.sequence(F.col("absent"), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda x: x), "r").alias("r"))
    queries = materialize(queries, "trigram-questions")
    first = _similar(prefix_candidates(queries, items, F.lit(0.35), 0.35), queries, items)
    kth = top_k(first, ["query_id"], [F.desc("sim"), "section_id"], k).where(F.col("rank") == k).select("query_id", F.col("sim").alias("bound"))
    bounded = materialize(queries.join(kth, "query_id", "left").withColumn("t", F.greatest(F.lit(floor), F.coalesce("bound", F.lit(floor)) - 1e-6)), "trigram-bounds")
    pairs = materialize(prefix_candidates(bounded, items, F.col("t"), floor), "trigram-pairs")
    if counted is not None:
        counted["pairs"] = pairs.count()
    sims = _similar(pairs, queries, items).where(F.col("sim") > floor)
    return top_k(sims, ["query_id"], [F.desc("sim"), "section_id"], k)


def hybrid_search(dense_hits: DataFrame, keyword_hits: DataFrame, floor: float = 0.45, pool: int = 40, k: int = 8) -> DataFrame:
    """query_id, bucket, item, rrf and rank: both lists ranked in their bucket (a jurisdiction), the dense one above its floor, fused; the best k of each bucket.

    Both: query_id, bucket, item, score. Equal sums are ordered by the dense rank, then the keyword rank, then the item.
    """
    ranked = lambda df: top_k(df, ["query_id", "bucket"], [F.desc("score"), "item"], pool)
    a = ranked(dense_hits).where(F.col("score") >= floor).select("query_id", "bucket", "item", F.col("rank").alias("d"), F.lit(None).cast("int").alias("w"))
    b = ranked(keyword_hits).select("query_id", "bucket", "item", F.lit(None).cast("int").alias("d"), F.col("rank").alias("w"))
    part = lambda c: F.coalesce(1 / (60 + F.max(c)), F.lit(0.0))
    fused = a.unionByName(b).groupBy("query_id", "bucket", "item").agg(F.round(part("d") + part("w"), 9).alias("rrf"), F.coalesce(F.max("d"), F.lit(1 << 30)).alias("d"), F.coalesce(F.max("w"), F.lit(1 << 30)).alias("w"))
    return top_k(fused, ["query_id", "bucket"], [F.desc("rrf"), "d", "w", "item"], k).select("query_id", "bucket", "item", "rrf", "rank")


def nearest_exemplar(queries: DataFrame, exemplars: DataFrame, floor: float = 0.35, outside: str = "out_of_scope") -> DataFrame:
    """query_id, intent and score: of the exemplar with the greatest cosine, the first of equal ones; outside below the floor. exemplars: position, intent, vec (a small fixed set)."""
    scored = dense(queries, exemplars)
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("intent", "score"), F.struct("score", (-F.col("position")).alias("p"))).alias("b"))
    return best.select("query_id", F.when(F.col("b.score") >= floor, F.col("b.intent")).otherwise(outside).alias("intent"), F.col("b.score").alias("score"))


def matching_models(queries: DataFrame, versions: DataFrame, model: str) -> DataFrame:
    """Queries whose corpus version was embedded with the model at hand; only these may be searched by vectors."""
    return queries.join(versions.where(F.col("embedding_model") == model).select("version"), "version", "left_semi")


def reranked(ranked: DataFrame, n: int) -> DataFrame:
    """The first n of each query; their order stays."""
    return ranked.where(F.col("rank") <= n)


#: Query vectors that meet all items at once.
BLOCK = 20_000


def dense(queries: DataFrame, items: DataFrame, query_vector: str = "qvec", item_vector: str = "vec") -> DataFrame:
    """All pairs with their cosine. Vectors that are null, zero or of another length give no row.

    Queries are a stated set: they are broadcast if few, else dealt to blocks, and each block meets all items, so that no task holds all rows.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    q = queries.withColumn("_qn", norm(query_vector)).where("_qn > 0")
    i = items.withColumn("_in", norm(item_vector)).where("_in > 0")
    dot = F.aggregate(F.zip_with(query_vector, item_vector, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    same = F.size(query_vector) == F.size(item_vector)
    blocks = -(-q.count() // BLOCK)
    if blocks <= 1:
        pairs = i.join(F.broadcast(q), same)
    else:
        dealt = q.withColumn("_block", F.pmod(F.xxhash64(query_vector), F.lit(blocks)))
        spread = i.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        pairs = spread.join(dealt, "_block").where(same).drop("_block")
    return pairs.withColumn("score", F.round(dot / (F.col("_qn") * F.col("_in")), 6)).drop("_qn", "_in")


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of the trigram sets of two texts."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def keyword_merge(first: DataFrame, second: DataFrame, keys: list[str] = ["query_id", "chunk_id"]) -> DataFrame:  # noqa: B006
    """The first ranked list, then what only the second has; new ranks by position."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.join(first, keys, "left_anti").withColumn("list", F.lit(1)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(keys[0]).orderBy("list", "rank")))


def reciprocal_rank_fusion(lists: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """keys and rrf, the sum of 1 / (k + rank) over ranked lists."""
    every = reduce(DataFrame.unionByName, [x.select(*keys, "rank") for x in lists])
    return every.groupBy(*keys).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf"))


def margin(ranked: DataFrame, key: str = "query_id", score: str = "score") -> DataFrame:
    """How far the best candidate leads: 1 with fewer than two, 0 if the best scores no more than 0."""
    tops = ranked.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col(score))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("b"))
    return tops.select(key, F.round(F.when(F.col("b").isNull(), 1.0).when(F.col("a") <= 0, 0.0).otherwise((F.col("a") - F.col("b")) / F.col("a")), 6).alias("margin"))


def budget_pack(ranked: DataFrame, budget: int, size: str = "size", key: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Items accepted in rank order while they fit what is left; what doesn't fit is skipped. A fold over the ranked list of each query."""
    packed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(size).cast("int").alias("size"), F.col(item).alias("item")))).alias("r"))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("picked"))
    fold = lambda a, x: F.when(x["size"] <= a["left"], F.struct((a["left"] - x["size"]).alias("left"), F.concat(a["picked"], F.array(x["item"])).alias("picked"))).otherwise(a)
    return packed.select(key, F.aggregate("r", start, fold).alias("a")).select(key, F.col("a.left").alias("left"), F.array_join("a.picked", ",").alias("picked"))

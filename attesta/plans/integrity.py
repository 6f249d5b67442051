"""Queries of the integrity, structure and quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import integrity, quality, structure
from attesta.plans import corpus
from attesta.plans.corpus import C_CHUNKS, C_DOCUMENTS
from attesta.session import materialize, table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT doc_id, sha256(text) AS leaf FROM documents")
def sha_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", integrity.sha(F.col("text")).alias("leaf"))


_CHAIN = """RECURSIVE e AS (SELECT user_id, event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), chain AS (
  SELECT user_id, event_id, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || props) AS entry_hash FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, c.entry_hash, sha256(c.entry_hash || e.props) FROM chain c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1
)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.chain(table(spark, sf_dir, "events"), "user_id", "event_id", "props")


@query(f"WITH {_CHAIN} SELECT user_id, event_id, prev_hash, entry_hash FROM chain")
def hash_chain_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir)


@query(f"WITH {_CHAIN} SELECT c.user_id, c.event_id FROM chain c WHERE event_id % 500 = 7")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampered payloads must show up, and nothing else."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 500 == 7, F.concat("props", F.lit(" "))).otherwise(F.col("props")).alias("props"))
    return integrity.chain_breaks(_chain(spark, sf_dir).join(e, "event_id"), "user_id", "event_id", "props").select("user_id", "event_id")


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "doc_id", integrity.sha(F.col("text")).alias("leaf"))


@query("""WITH RECURSIVE leaves AS (SELECT source AS tree, list(sha256(text) ORDER BY doc_id) AS l FROM documents GROUP BY source), up AS (
  SELECT tree, l FROM leaves UNION ALL
  SELECT tree, list_transform(range(1, len(l) + 1, 2), lambda i: CASE WHEN i = len(l) THEN l[i] ELSE sha256(unhex(l[i] || l[i + 1])) END) FROM up WHERE len(l) > 1
) SELECT tree AS source, l[1] AS root FROM up WHERE len(l) = 1""")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.merkle_roots(_leaves(spark, sf_dir), "source", "doc_id", "leaf")


@query("""WITH RECURSIVE leaves AS (SELECT source AS tree, list(sha256(text) ORDER BY doc_id) AS l FROM documents GROUP BY source), up AS (
  SELECT tree, 0 AS k, l FROM leaves UNION ALL
  SELECT tree, k + 1, list_transform(range(1, len(l) + 1, 2), lambda i: CASE WHEN i = len(l) THEN l[i] ELSE sha256(unhex(l[i] || l[i + 1])) END) FROM up WHERE len(l) > 1
), own AS (SELECT tree, l, unnest(range(0, len(l))) AS i FROM leaves), steps AS (
  SELECT own.tree, own.i, up.k, CAST(own.i // CAST(pow(2, up.k) AS BIGINT) AS BIGINT) AS pos, up.l FROM own JOIN up ON up.tree = own.tree
), sib AS (SELECT tree, i, k, pos % 2 = 1 AS is_left, l[CASE WHEN pos % 2 = 1 THEN pos ELSE pos + 2 END] AS s FROM steps WHERE len(l) > 1)
SELECT tree AS source, i, string_agg((CASE WHEN is_left THEN 'L' ELSE 'R' END) || substr(s, 1, 16), ',' ORDER BY k) AS proof FROM sib WHERE s IS NOT NULL GROUP BY tree, i""")
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = integrity.merkle_proofs(_leaves(spark, sf_dir), "source", "doc_id", "leaf")
    step = F.transform("proof", lambda s: F.concat(F.when(s["left"], "L").otherwise("R"), F.substring(s["sibling"], 1, 16)))
    return p.select(F.col("tree").alias("source"), "i", F.array_join(step, ",").alias("proof"))


_APPENDED = _CHAIN.replace("ORDER BY event_id", "ORDER BY event_id % 3, event_id")


@query(f"WITH {_APPENDED} SELECT user_id, event_id, n - 1 AS place, prev_hash, entry_hash FROM chain")
def chain_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events come in three batches, each of which goes on from the stored heads; all entries are those of one fold."""
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").select("user_id", (k + k % 3 * 10**12).alias("seq"), "props")
    heads, parts = None, []
    for batch in range(3):
        new = integrity.append_chain(events.where(F.floor(F.col("seq") / 10**12) == batch), heads, "user_id", "seq", "props")
        parts.append(materialize(new, "chain"))
        heads = integrity.chain_heads(parts[-1], heads, "user_id", "seq")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("user_id", (F.col("seq") % 10**12).alias("event_id"), "place", "prev_hash", "entry_hash")


@query("""WITH RECURSIVE leaves AS (SELECT source AS tree, list(sha256(text) ORDER BY doc_id % 3, doc_id) AS l FROM documents GROUP BY source), up AS (
  SELECT tree, len(l) AS leaves, l FROM leaves UNION ALL
  SELECT tree, leaves, list_transform(range(1, len(l) + 1, 2), lambda i: CASE WHEN i = len(l) THEN l[i] ELSE sha256(unhex(l[i] || l[i + 1])) END) FROM up WHERE len(l) > 1
) SELECT tree AS source, leaves, bit_count(leaves) AS nodes, l[1] AS root FROM up WHERE len(l) = 1""")
def merkle_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in three batches; each meets only the frontier that the ones before it left."""
    leaves, frontier = _leaves(spark, sf_dir), None
    for batch in range(3):
        frontier = integrity.append_merkle(leaves.where(F.col("doc_id") % 3 == batch), frontier, "source", "doc_id", "leaf")
    sizes = frontier.groupBy("source").agg(F.sum(F.expr("shiftleft(1L, level)")).alias("leaves"), F.count("*").cast("tinyint").alias("nodes"))
    return sizes.join(integrity.frontier_roots(frontier, "source"), "source")


@query("SELECT source, count(*) AS n, true AS valid, true AS tampered_fails FROM documents GROUP BY source")
def proof_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    p = integrity.merkle_proofs(leaves, "source", "doc_id", "leaf").join(integrity.merkle_roots(leaves, "source", "doc_id", "leaf").withColumnRenamed("source", "tree"), "tree")
    good = integrity.proof_root(F.col("leaf"), F.col("proof")) == F.col("root")
    bad = integrity.proof_root(integrity.sha(F.col("leaf")), F.col("proof")) != F.col("root")
    return p.groupBy(F.col("tree").alias("source")).agg(F.count("*").alias("n"), F.bool_and(good).alias("valid"), F.bool_and(bad).alias("tampered_fails"))


@query(f"""WITH {C_CHUNKS}, spans AS (SELECT CASE WHEN line % 9 = 8 THEN 'gone' || chunk_id ELSE chunk_id END AS chunk_id, CASE WHEN line % 7 = 3 THEN sha256(text || '!') ELSE sha256(text) END AS digest FROM c_chunks)
SELECT s.chunk_id, c.chunk_id IS NOT NULL AS in_corpus, coalesce(sha256(c.text) = s.digest, false) AS text_valid FROM spans s LEFT JOIN c_chunks c ON c.chunk_id = s.chunk_id""")
def receipt_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.chunks(spark, sf_dir)
    spans = c.select(
        F.when(F.col("line") % 9 == 8, F.concat(F.lit("gone"), "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), integrity.sha(F.when(F.col("line") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest")
    )
    return integrity.receipt_check(spans, c, "chunk_id", "digest", "text").select("chunk_id", "in_corpus", "text_valid")


@query("""WITH p AS (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS digest FROM documents WHERE source <> 'src3' GROUP BY source), f AS (
  SELECT source, CASE WHEN source = 'src5' THEN NULL ELSE string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) END AS digest FROM documents WHERE source <> 'src4' AND NOT (source = 'src6' AND doc_id % 2 = 0) GROUP BY source)
SELECT coalesce(p.source, f.source) AS source, CASE WHEN f.source IS NULL THEN 'removed' WHEN f.digest IS NULL THEN 'check_failed' WHEN p.source IS NULL THEN 'added' WHEN p.digest = f.digest THEN 'unchanged' ELSE 'changed' END AS status FROM p FULL OUTER JOIN f ON f.source = p.source""")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    digest = lambda x: integrity.set_digest(x, "source", "doc_id")
    p = digest(d.where("source <> 'src3'"))
    f = digest(d.where("source <> 'src4' AND NOT (source = 'src6' AND doc_id % 2 = 0)")).withColumn("digest", F.when(F.col("source") != "src5", F.col("digest")))
    return integrity.changes(p, f, "source")


_PROMOTED = f"""WITH RECURSIVE {C_DOCUMENTS}, both_ AS (
  SELECT doc_type AS version, 'now' AS k, list(sha256(text) ORDER BY doc_id) AS l FROM c_documents GROUP BY doc_type
  UNION ALL SELECT doc_type, 'stored', list(CASE WHEN doc_id % 16 = 5 THEN sha256('') ELSE sha256(text) END ORDER BY doc_id) FROM c_documents GROUP BY doc_type
), up AS (
  SELECT version, k, l FROM both_ UNION ALL
  SELECT version, k, list_transform(range(1, len(l) + 1, 2), lambda i: CASE WHEN i = len(l) THEN l[i] ELSE sha256(unhex(l[i] || l[i + 1])) END) FROM up WHERE len(l) > 1
), roots AS (SELECT version, max(CASE WHEN k = 'now' THEN l[1] END) AS root, max(CASE WHEN k = 'stored' THEN l[1] END) AS stored FROM up WHERE len(l) = 1 GROUP BY version),
v AS (SELECT doc_type AS version, min(doc_id % 8) AS n, count(*) FILTER (WHERE length(text) < 20) AS issues, count(*) FILTER (WHERE source = 'src0') / CAST(count(*) AS DOUBLE) AS miss, count(*) FILTER (WHERE n_chars <> length(c.text)) AS files FROM c_documents c JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) GROUP BY doc_type)
"""


@query(_PROMOTED + """SELECT v.version, f AS failed FROM v JOIN roots USING (version), LATERAL (SELECT unnest([CASE WHEN n % 2 = 1 THEN 'not_staged' END, CASE WHEN n = 2 THEN 'approval' END, CASE WHEN issues > 0 THEN 'issues' END, CASE WHEN 1 - miss < 0.8 THEN 'recall' END, CASE WHEN root <> stored THEN 'root' END, CASE WHEN files > 0 THEN 'files' END]) AS f) x WHERE f IS NOT NULL""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by document type: roots of the texts now and as approved, where some documents of one type changed since."""
    d = corpus.documents(spark, sf_dir).withColumn("version", F.col("doc_type"))
    now = integrity.merkle_roots(d.withColumn("leaf", integrity.sha(F.col("text"))), "version", "doc_id", "leaf")
    stored = integrity.merkle_roots(d.withColumn("leaf", integrity.sha(F.when(F.col("doc_id") % 16 == 5, "").otherwise(F.col("text")))), "version", "doc_id", "leaf").withColumnRenamed("root", "stored_root")
    sizes = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = F.col("n")
    figures = d.join(sizes, "doc_id").groupBy("version").agg(
        F.min(F.col("doc_id") % 8).alias("n"), F.count_if(F.length("text") < 20).alias("issues"), (1 - F.count_if(F.col("source") == "src0") / F.count("*")).alias("recall"), F.count_if(F.col("n_chars") != F.length("text")).alias("changed_files"))
    checks = figures.join(now, "version").join(stored, "version").select(
        "version", F.when(n % 2 == 1, "live").otherwise("staged").alias("status"), F.when(n == 2, " ").otherwise("reviewer").alias("reviewer"), "root", "stored_root", F.col("root").alias("approved_hash"), F.col("root").alias("report_hash"), "issues", "recall", F.lit(0).alias("leaks"),
        F.lit("g").alias("golden"), F.lit("g").alias("stored_golden"), F.lit("m").alias("manifest"), F.lit("m").alias("stored_manifest"), "changed_files")
    return integrity.promotion_failures(checks)


@query()
def receipt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each user turn, in one chain a conversation."""
    return _receipts(spark, sf_dir).select("log", "seq", "receipt_id", "result_hash", "prev_hash", "entry_hash")


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    docs = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), F.array(F.struct(F.concat(F.lit("ev_"), "doc_key").alias("evidence_id"), "doc_id", integrity.sha(F.col("text")).alias("sha256"))).alias("s"), "version")
    named = c.join(docs, "conv_id", "left").withColumn("spans", F.coalesce(F.transform("s", lambda x: F.struct(x["evidence_id"].alias("evidence_id"), x["doc_id"].alias("chunk_id"), x["sha256"].alias("sha256"))), F.array().cast("array<struct<evidence_id:string,chunk_id:bigint,sha256:string>>")))
    results = named.select(
        F.col("conv_id").alias("log"), F.col("turn").alias("seq"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), F.coalesce("version", F.lit("none")).alias("corpus_version"), integrity.sha(F.col("text")).alias("query_hash"), "spans",
        F.struct(F.lit("none").alias("llm"), F.lit("none").alias("embed")).alias("model_ids"), F.lit("v1").alias("prompt_version"), F.to_json(F.struct(F.col("text").alias("message"), F.lit("").alias("receipt_id"))).alias("result"), F.lit(None).cast("string").alias("request"), F.lit("2024-01-01T00:00:00Z").alias("ts"))
    return integrity.build_receipts(results, "log", "seq")


@query("SELECT conv_id AS log, turn AS seq, true AS chain_valid, CASE WHEN d.doc_id IS NULL THEN NULL ELSE d.doc_id % 7 <> 3 END AS proof_valid FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE role = 'user'")
def receipt_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts against a corpus in which some texts changed after their leaves were stored."""
    d = corpus.documents(spark, sf_dir).select(F.col("version").alias("corpus_version"), F.col("doc_id").alias("chunk_id"), integrity.sha(F.col("text")).alias("sha256"), F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    roots = integrity.merkle_roots(d, "corpus_version", "chunk_id", "sha256")
    chained, spans = integrity.verify_receipts(_receipts(spark, sf_dir), "log", "seq", d, roots)
    return chained.join(spans.select("log", "seq", "proof_valid"), ["log", "seq"], "left").select("log", "seq", "chain_valid", "proof_valid")


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id, CASE WHEN turn % 9 = 4 THEN 'mismatch' ELSE 'ok' END AS integrity FROM conversations WHERE role = 'user'")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results with the receipt's id put in later; every ninth was edited."""
    r = _receipts(spark, sf_dir)
    later = F.concat(F.lit('{"receipt_id":"'), "receipt_id", F.lit('",'), F.expr("substring(result, 2)"))
    stored = r.select("request_id", F.when(F.col("seq") % 9 == 4, F.replace(later, F.lit('"message":"'), F.lit('"message":"!'))).otherwise(later).alias("result"))
    return integrity.result_integrity(stored.withColumn("result", F.replace("result", F.lit(',"receipt_id":""'), F.lit(""))), r)


@query()
def review_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.chunks(spark, sf_dir).withColumn("digest", integrity.sha(F.col("text")))
    return integrity.review_root(c, "version", "chunk_id", "digest", ["line", "jurisdiction", "doc_type", "valid_from", "valid_to"])


@query(f"""WITH {C_CHUNKS}, s AS (SELECT chunk_id, doc_id, line, text, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(text) - 1 + CASE WHEN line % 13 = 5 THEN 1 ELSE 0 END AS BIGINT) AS start FROM c_chunks)
SELECT chunk_id, start + length(s.text) <= length(d.text) AND substr(d.text, start + 1, length(s.text)) = s.text AS offset_valid, line % 17 <> 3 AS sha_valid FROM s JOIN documents d ON d.doc_id = s.doc_id""")
def offset_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = structure.page_offsets(corpus.chunks(spark, sf_dir), "doc_id", "line", "text")
    start = (F.col("start") + F.when(F.col("line") % 13 == 5, 1).otherwise(0)).cast("int")
    spans = c.select("chunk_id", "doc_id", "line", "text", start.alias("char_start"), (start + F.length("text")).alias("char_end"), F.when(F.col("line") % 17 == 3, "x").otherwise(integrity.sha(F.col("text"))).alias("sha256"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("full_text"))
    return integrity.chunk_invariants(spans, docs, "doc_id").select("chunk_id", "offset_valid", "sha_valid")


@query(f"WITH {C_CHUNKS} SELECT chunk_id, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(text) - 1 AS BIGINT) AS start FROM c_chunks")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.page_offsets(corpus.chunks(spark, sf_dir), "doc_id", "line", "text").select("chunk_id", "start")


@query(f"""WITH {C_CHUNKS}, starts AS (SELECT doc_id, line, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(text) - 1 AS start FROM c_chunks), asked AS (SELECT doc_id, n_chars * k // 4 AS at FROM documents, range(4) r(k) WHERE n_chars > 8)
SELECT a.doc_id, CAST(a.at AS BIGINT) AS at, CAST(max(line) AS INTEGER) AS page FROM asked a JOIN starts s ON s.doc_id = a.doc_id AND s.start <= a.at GROUP BY a.doc_id, a.at""")
def page_for_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = structure.page_offsets(corpus.chunks(spark, sf_dir), "doc_id", "line", "text").select("doc_id", F.col("line").alias("page"), "start")
    asked = table(spark, sf_dir, "documents").where("n_chars > 8").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "n_chars").select("doc_id", F.floor(F.col("n_chars") * F.col("k") / 4).cast("bigint").alias("at"))
    return structure.page_at(asked, pages, "doc_id", "at").select("doc_id", "at", "page")


_LINES = """lines AS (SELECT user_id AS doc, event_id AS place, event_id * 37 % 101 % 12 + 1 AS number FROM events)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("place"), (F.col("event_id") * 37 % 101 % 12 + 1).alias("number"))


@query(f"WITH {_LINES} SELECT doc, place, CAST(coalesce(lead(place) OVER (PARTITION BY doc ORDER BY place), least(100000, place + 2)) AS BIGINT) AS until FROM lines")
def section_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.slices(_lines(spark, sf_dir).withColumn("end", F.col("place")).withColumn("size", F.lit(100000).cast("bigint")), "doc", "place", "end", "size", 2).select("doc", "place", "until")


@query(f"WITH {_LINES} SELECT doc, place, number FROM (SELECT *, max(number) OVER (PARTITION BY doc ORDER BY place) AS m FROM lines) WHERE number = m")
def monotonic_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.monotonic(_lines(spark, sf_dir), "doc", "place", "number").select("doc", "place", "number")


@query("WITH lines AS (SELECT user_id AS doc, event_id AS place, CASE WHEN event_id % 41 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY user_id ORDER BY event_id) END AS number FROM events), ok AS (SELECT *, number = row_number() OVER (PARTITION BY doc ORDER BY place) AS o FROM lines) SELECT doc, place FROM (SELECT *, bool_and(o) OVER (PARTITION BY doc ORDER BY place) AS a FROM ok) WHERE a")
def sequential_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(structure.by("user_id", "event_id"))
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("place"), F.when(F.col("event_id") % 41 == 0, 0).otherwise(nth).alias("number"))
    return structure.sequential_run(lines, "doc", "place", "number").select("doc", "place")


@query(f"WITH {_LINES}, ok AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n, coalesce(number > lag(number) OVER (PARTITION BY doc ORDER BY place), true) AS o FROM lines) SELECT doc, place FROM (SELECT *, bool_and(o) OVER (PARTITION BY doc ORDER BY place) AS a FROM ok) WHERE a AND n >= 2")
def letter_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.increasing_prefix(_lines(spark, sf_dir), "doc", "place", "number").select("doc", "place")


@query(f"WITH {_LINES} SELECT doc, number + 1 AS missing FROM (SELECT *, lead(number) OVER (PARTITION BY doc ORDER BY place) AS n FROM lines) WHERE n - number = 2")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.gaps(_lines(spark, sf_dir), "doc", "place", "number").select("doc", "missing")


@query("""WITH lines AS (SELECT user_id AS doc, event_id AS place, event_id % 7 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS number FROM events), b AS (
  SELECT *, CASE WHEN coalesce(lag(number) OVER (PARTITION BY doc ORDER BY place) + 1 = number, false) THEN 0 ELSE 1 END AS b FROM lines
), r AS (SELECT *, sum(b) OVER (PARTITION BY doc ORDER BY place) AS run FROM b), s AS (SELECT doc, run, min(number) AS low, count(*) AS length, min(place) AS first FROM r GROUP BY doc, run)
SELECT doc, first, length FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY length DESC, first DESC) AS k FROM s WHERE low = 1 AND length >= 3) WHERE k = 1""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), k.alias("place"), (k % 7 + F.when(k % 5 == 0, 1).otherwise(0)).alias("number"))
    return structure.longest_run(lines, "doc", "place", "number")


@query("""WITH s AS (SELECT event_id AS id, event_type || CAST(user_id % 40 AS VARCHAR) AS key, event_id // 50 AS page FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS a FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY key, page, a > 1 ORDER BY id) AS n FROM k)
SELECT id, CASE WHEN a = 1 THEN key ELSE key || '-p' || CAST(page AS VARCHAR) || CASE WHEN n > 1 THEN '-' || CAST(n AS VARCHAR) ELSE '' END END AS unique_key FROM n""")
def dup_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("key"), F.floor(F.col("event_id") / 50).alias("page"))
    return structure.unique_keys(s, "key", "page", "id").select("id", "unique_key")


@query("""WITH d AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' Provided that x' WHEN 2 THEN ' Explanation.— y' ELSE ' Provided that x Explanation.— y' END AS t FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN t WHEN 1 THEN rtrim(left(t, length(t) - 15), chr(10) || ' ') ELSE rtrim(left(t, length(t) - 15), chr(10) || ' ') END AS body,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'proviso' ELSE 'explanation' END AS kind, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Provided that x' ELSE 'Explanation.— y' END AS child FROM d""")
def proviso_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, "").when(k == 1, " Provided that x").when(k == 2, " Explanation.— y").otherwise(" Provided that x Explanation.— y")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("t"))
    return d.select("doc_id", structure.proviso_split(F.col("t")).alias("p")).select("doc_id", "p.body", "p.kind", "p.child")


@query("""WITH s AS (SELECT l_orderkey AS k, greatest(0, CAST(l_quantity AS INTEGER) * 3 - 20) AS s, least(100, CAST(l_quantity AS INTEGER) * 3 + l_linenumber * 4 - 20) AS e FROM lineitem), cells AS (SELECT DISTINCT k, unnest(range(s, e)) AS c FROM s WHERE e > s), n AS (SELECT k, count(*) AS covered FROM cells GROUP BY k)
SELECT a.k, CAST(coalesce(n.covered, 0) AS BIGINT) AS covered FROM (SELECT DISTINCT k FROM s) a LEFT JOIN n ON n.k = a.k""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int") * 3
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (q - 20).alias("s"), (q + F.col("l_linenumber") * 4 - 20).alias("e"), F.lit(100).alias("total"))
    return quality.interval_coverage(s, "k", "s", "e", "total")


@query(f"""WITH {C_CHUNKS}, s AS (SELECT doc_id, line, text, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(text) - 1 + CASE WHEN line % 13 = 5 THEN 1 ELSE 0 END AS BIGINT) AS start FROM c_chunks),
k AS (SELECT s.*, length(d.text) AS total, start + length(s.text) <= length(d.text) AND substr(d.text, start + 1, length(s.text)) = s.text AS fits FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE line % 10 <> 9),
q AS (SELECT doc_id AS source, max(total) AS total, CAST(sum(greatest(0, least(start + length(text), total) - start)) AS BIGINT) AS covered, count(*) FILTER (WHERE NOT fits) AS invalid, count(*) FILTER (WHERE line % 7 = 3) AS missing FROM k GROUP BY doc_id)
SELECT source, covered, CAST(round(CASE WHEN total > 0 THEN CAST(covered AS DOUBLE) / total ELSE 0 END, 3) AS DOUBLE) AS coverage, invalid AS invalid_offsets, missing AS missing_boxes,
  array_to_string(list_filter([CASE WHEN CASE WHEN total > 0 THEN CAST(covered AS DOUBLE) / total ELSE 0 END < 0.7 THEN 'low_coverage' END, CASE WHEN invalid > 0 THEN 'invalid_offsets' END, CASE WHEN missing > 0 THEN 'missing_boxes' END], lambda x: x IS NOT NULL), ',') AS issues FROM q""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks of their document; some are left out, some are shifted by a character, some have no box."""
    c = structure.page_offsets(corpus.chunks(spark, sf_dir), "doc_id", "line", "text").where("line % 10 <> 9")
    start = (F.col("start") + F.when(F.col("line") % 13 == 5, 1).otherwise(0)).cast("int")
    spans = c.select(F.col("doc_id").alias("source"), "text", start.alias("char_start"), (start + F.length("text")).alias("char_end"), integrity.sha(F.col("text")).alias("sha256"), (F.col("line") % 7 != 3).alias("has_box"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.col("text").alias("full_text"))
    q = quality.extraction_quality(spans, docs, "source")
    return q.select("source", "covered", "coverage", "invalid_offsets", "missing_boxes", F.array_join("issues", ",").alias("issues"))


@query("""WITH gold AS (SELECT DISTINCT o_custkey AS q, o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0), got AS (SELECT DISTINCT o_custkey AS q, o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0), r AS (SELECT * FROM got WHERE q IN (SELECT q FROM gold)), n AS (
  SELECT (SELECT count(*) FROM r JOIN gold USING (q, k)) AS hits, (SELECT count(*) FROM r) AS retrieved, (SELECT count(*) FROM gold) AS gold)
SELECT hits, retrieved, gold, round(hits / CAST(gold AS DOUBLE), 2) AS recall, round(hits / CAST(retrieved AS DOUBLE), 2) AS precision FROM n""")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("k"))
    return quality.retrieval_figures(o.where("k % 4 = 0"), o.where("k % 3 = 0"), ["q", "k"])


_CASES = """cases AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'answerable' WHEN 1 THEN 'in_scope_no_evidence' ELSE 'out_of_domain' END AS scope, CASE doc_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'weak' ELSE 'indirect' END AS phrasing,
  CASE WHEN doc_id % 4 = 3 THEN doc_id % 8 = 3 ELSE doc_id % 4 = 0 OR doc_id % 8 = 1 END AS domain FROM documents)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with words that put half of some kinds in or out of the domain; the weather puts out what the domain put in."""
    k = F.col("doc_id")
    words = F.when(k % 8 == 3, "herbal export").when(k % 8 == 7, "herbal export in rain").when((k % 4 == 0) | (k % 8 == 1), "licence for a cosmetic").otherwise("a plain line")
    return table(spark, sf_dir, "documents").select(k.alias("case_id"), words.alias("question"), F.when(k % 4 == 0, "answerable").when(k % 4 == 1, "in_scope_no_evidence").otherwise("out_of_domain").alias("scope"), F.when(k % 3 == 0, "direct").when(k % 3 == 1, "weak").otherwise("indirect").alias("phrasing"))


@query(f"WITH {_CASES} SELECT scope AS name, 'scope' AS kind, count(*) AS n, round(avg(CASE WHEN domain = (scope <> 'out_of_domain') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM cases GROUP BY scope UNION ALL SELECT phrasing, 'phrasing', count(*), round(avg(CASE WHEN domain THEN 1.0 ELSE 0.0 END), 6) FROM cases WHERE scope = 'answerable' GROUP BY phrasing")
def routing_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.routing_figures(_cases(spark, sf_dir), "question")


@query("""WITH gold AS (SELECT o_custkey % 500 AS q, o_orderkey AS k, o_custkey % 500 % 7 = 3 AS abstain FROM orders WHERE o_orderkey % 3 = 0), got AS (SELECT DISTINCT o_custkey % 500 AS q, o_orderkey AS k, o_orderpriority <> '1-URGENT' AS allowed FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey % 500 % 14 <> 3), qs AS (SELECT q, bool_or(abstain) AS abstain FROM gold GROUP BY q),
g AS (SELECT DISTINCT gold.q, k FROM gold JOIN qs USING (q) WHERE NOT qs.abstain), r AS (SELECT DISTINCT got.q, k FROM got JOIN qs USING (q) WHERE NOT qs.abstain), n AS (
  SELECT (SELECT count(*) FROM r JOIN g USING (q, k)) AS hits, (SELECT count(*) FROM r) AS retrieved, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM qs WHERE abstain) AS abstentions, (SELECT count(*) FROM qs WHERE abstain AND q NOT IN (SELECT q FROM got)) AS abstained, (SELECT count(*) FROM got JOIN qs USING (q) WHERE NOT allowed) AS leaks)
SELECT hits, retrieved, gold, round(hits / CAST(gold AS DOUBLE), 2) AS recall, round(hits / CAST(retrieved AS DOUBLE), 2) AS precision, CASE WHEN abstentions > 0 THEN round(abstained / CAST(abstentions AS DOUBLE), 2) ELSE 0.0 END AS abstention_accuracy, leaks FROM n""")
def golden_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with gold keys, of which some should be abstained from; some rows retrieved are of a jurisdiction that wasn't asked."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("q"), F.col("o_orderkey").alias("k"), (F.col("o_orderpriority") != "1-URGENT").alias("allowed"))
    gold = o.where("k % 3 = 0").select("q", "k", (F.col("q") % 7 == 3).alias("abstain"))
    got = o.where("k % 4 = 0 AND q % 14 <> 3").distinct()
    return quality.golden_figures(got, gold, "q", "k")


@query("""WITH idx AS (SELECT list(DISTINCT source) AS l FROM documents WHERE doc_id % 2 = 0), t AS (SELECT c_nationkey AS topic, CASE WHEN c_nationkey = 3 THEN [] ELSE ['src' || CAST(c_nationkey AS VARCHAR), 'src' || CAST(c_nationkey + 12 AS VARCHAR)] END AS s FROM (SELECT DISTINCT c_nationkey FROM customer))
SELECT topic, CASE WHEN len(s) = 0 THEN 'special' WHEN len(list_intersect(s, l)) = len(s) THEN 'indexed' WHEN len(list_intersect(s, l)) > 0 THEN 'partial' ELSE 'not_indexed' END AS status FROM t, idx""")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").agg(F.collect_set("source").alias("have"))
    n = F.col("topic")
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("topic")).distinct().withColumn("s", F.when(n == 3, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src"), n.cast("string")), F.concat(F.lit("src"), (n + 12).cast("string")))))
    return t.crossJoin(F.broadcast(have)).select("topic", quality.topic_status("s", "have").alias("status"))


@query()
def lis_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.longest_increasing_rows(_lines(spark, sf_dir), "doc", "place", "number")

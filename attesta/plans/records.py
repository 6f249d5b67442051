"""Queries of history, sources and streaming operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import history
from attesta.operators.integrity import merkle_roots
from attesta.operators.stages import run_stages
from attesta.session import shared_dir, table
from attesta.sources import commits, files
from attesta.streaming.rate_limit import rate_limit as limit_hits

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""WITH n AS (SELECT conv_id, turn, role || ': ' || substr(text, 1, 600) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, right(string_agg(t, chr(10) ORDER BY turn), 2400) AS context FROM n WHERE k <= 6 GROUP BY conv_id""")
def recent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("expires_at"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'")
def ttl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(history.visible("1998-01-01 00:00:00")).select("o_orderkey")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00') GROUP BY l_returnflag")
def ttl_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, lines = history.purge(_orders(spark, sf_dir), [(table(spark, sf_dir, "lineitem"), "l_orderkey")], "o_orderkey", "1998-01-01 00:00:00")
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""WITH have AS (SELECT o_custkey AS c, o_orderkey AS i, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS position FROM orders WHERE o_orderkey % 3 = 0), new AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS i FROM orders WHERE o_orderkey % 2 = 0), fresh AS (
  SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.c = new.c AND have.i = new.i))
SELECT f.c, f.i, CAST(coalesce(m, 0) + row_number() OVER (PARTITION BY f.c ORDER BY f.i) AS INTEGER) AS position FROM fresh f LEFT JOIN (SELECT c, max(position) AS m FROM have GROUP BY c) h ON h.c = f.c""")
def case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("i"))
    have = o.where("i % 3 = 0").withColumn("position", F.row_number().over(Window.partitionBy("c").orderBy("i")))
    return history.append_positions(have, o.where("i % 2 = 0"), "c", "i", "i")


@query("""WITH r AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id), results AS (SELECT user_id + CASE WHEN user_id % 9 = 0 THEN 100000 ELSE 0 END AS user_id, CASE WHEN user_id % 7 = 0 THEN 'x' ELSE props END AS digest FROM r JOIN events USING (user_id) WHERE event_id = last)
SELECT s.user_id, CASE WHEN e.props IS NULL THEN 'missing' WHEN e.props = s.digest THEN 'ok' ELSE 'mismatch' END AS integrity FROM results s LEFT JOIN (SELECT e.user_id, e.props FROM events e JOIN r ON r.user_id = e.user_id AND r.last = e.event_id) e ON e.user_id = s.user_id""")
def result_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("props").alias("digest"))
    k = F.col("user_id")
    results = history.latest(audit, "user_id", "event_id").select((k + F.when(k % 9 == 0, 100000).otherwise(0)).alias("user_id"), F.when(k % 7 == 0, "x").otherwise(F.col("digest")).alias("digest"))
    return history.integrity_of(results, audit, "user_id", "event_id").select("user_id", "integrity")


@query("""SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || CASE WHEN turn % 5 = 4 THEN '_missing_' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""")
def dossier_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("body", F.when(F.col("turn") % 5 != 4, F.col("text")))
    return history.dossier(c, "conv_id", "turn", "role", "body")


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS cur FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN false WHEN o_custkey % 4 = 1 THEN len(cur) = 0 ELSE true END AS ok FROM o""")
def reorder_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 4
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("cur"))
    wanted = F.when(k == 0, F.concat("cur", F.slice("cur", 1, 1))).when(k == 1, F.transform("cur", lambda x: x + 1)).otherwise(F.reverse("cur"))
    return o.withColumn("w", wanted).select("o_custkey", history.is_permutation("w", "cur").alias("ok"))


@query("""WITH t AS (SELECT unnest(['qa', 'abs', 'tk', 'classify', 'dossier']) AS i, unnest(['ask', 'share', 'match', 'sort', 'export']) AS s, unnest([1, 2, 3, 4, 5]) AS n), o AS (SELECT o_orderkey, (['qa', 'abs', 'tk', 'classify', 'none'])[o_orderkey % 5 + 1] AS own FROM orders), r AS (
  SELECT o_orderkey, s, n, row_number() OVER (PARTITION BY o_orderkey ORDER BY n) AS k FROM o JOIN t ON t.i <> o.own) SELECT o_orderkey, string_agg(s, ',' ORDER BY n) AS next FROM r WHERE k <= 3 GROUP BY o_orderkey""")
def suggested_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.element_at(F.array(*map(F.lit, ["qa", "abs", "tk", "classify", "none"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    templates = [("qa", "ask"), ("abs", "share"), ("tk", "match"), ("classify", "sort"), ("dossier", "export")]
    return table(spark, sf_dir, "orders").withColumn("own", own).select("o_orderkey", F.array_join(history.followups("own", templates), ",").alias("next"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS t FROM pages) SELECT page_id, href, trim(regexp_replace(t, '<[^>]*>', '', 'g'), ' ') AS text FROM l""")
def anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.anchors(table(spark, sf_dir, "pages"), "page_id", "html").drop("place")


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_type, ' ', ' ; '), ';'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS parts FROM part")
def csv_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(files.split_list(F.replace("p_type", F.lit(" "), F.lit(" ; "))), "|").alias("parts"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, CASE WHEN doc_id % 4 <> 0 THEN 'not_pdf' WHEN doc_id % 8 = 0 THEN 'changed' ELSE 'ok' END AS verdict FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '%PDF-1.7 ' ELSE '' END || text AS text FROM documents)")
def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(k.cast("string").alias("path"), F.concat(F.when(k % 4 == 0, "%PDF-1.7 ").otherwise(""), "text").cast("binary").alias("content"), k)
    pins = d.where("doc_id % 3 = 0 OR doc_id % 8 = 0").select("path", F.when(F.col("doc_id") % 8 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return files.fetched(d, pins)


@query("SELECT doc_id, source, sha256(text) AS digest FROM documents")
def snapshot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version is written, and read back with its digests checked."""
    import uuid

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    files.write_version(d, path, "v1")
    leaves = d.select(F.lit("v1").alias("tree"), "chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    root = merkle_roots(leaves, "tree", "chunk_id", "sha256").first()["root"]
    return files.read_version(spark, path, "v1", leaves, root).select(F.col("chunk_id").alias("doc_id"), "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("""WITH d AS (SELECT doc_id, text, sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 2 = 1), e AS (SELECT doc_id FROM d WHERE doc_id % 3 = 0)
SELECT 'versions' AS name, CAST(1 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS ids, CAST(NULL AS VARCHAR) AS first UNION ALL
SELECT 'documents', count(*), CAST(sum(doc_id) AS BIGINT), min(sha) FROM d UNION ALL SELECT 'sections', count(*), CAST(sum(doc_id) AS BIGINT), min(sha) FROM d UNION ALL
SELECT 'chunks', count(*), CAST(sum(doc_id) AS BIGINT), min(sha) FROM d UNION ALL SELECT 'document_versions', count(*), CAST(sum(doc_id) AS BIGINT), min(sha) FROM d UNION ALL
SELECT 'edges', count(*), CAST(sum(doc_id) AS BIGINT), NULL FROM e""")
def version_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions are written and committed, one of them twice; it goes live, and its six tables are exported and restored."""
    import uuid

    path = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("v"), F.col("doc_id") % 2).alias("version"), "text", digest)
    parts = lambda x: {"sections": x, "chunks": x, "edges": x.where("document_id % 3 = 0").select("document_id", "version", F.lit("refers_to").alias("kind")), "document_versions": x.drop("text")}
    files.write_source(parts(d.where("version = 'v0'")), path, "v0", "all")
    files.write_source(parts(d.where("version = 'v1'").withColumn("sha256", F.lit("old"))), path, "v1", "all")
    files.write_source(parts(d.where("version = 'v1'")), path, "v1", "all")
    commits.promote(spark, path, "v1", spark.createDataFrame([], "version string, failed string"), commits.newest(spark, path))
    states = commits.statuses(spark, path)
    live = states.where("status = 'live'").first()["version"]
    files.save_snapshot({n: files.read_source_tables(spark, path, live, n) for n in files.TABLES} | {"versions": states, "documents": d.drop("version")}, live, f"{path}/export")
    rows = [
        t.select(F.lit(n).alias("name"), (F.col("document_id") if "document_id" in t.columns else F.lit(None)).cast("bigint").alias("id"), (F.col("sha256") if "sha256" in t.columns else F.lit(None)).cast("string").alias("sha"))
        for n, t in files.load_snapshot(spark, f"{path}/export").items()]
    return reduce(DataFrame.unionByName, rows).groupBy("name").agg(F.count("*").alias("rows"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"), F.min("sha").alias("first"))


@query("""SELECT 0 AS position, 'read' AS stage, 'done' AS status, count(*) AS rows, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters, count(*) FILTER (WHERE length(text) < 200) AS short FROM documents UNION ALL
SELECT 1, 'translate', 'skipped', 0, 0, 0 UNION ALL
SELECT 2, 'filled', 'done', count(*), CAST(coalesce(sum(length(text)), 0) AS BIGINT), count(*) FILTER (WHERE length(text) < 200) FROM documents WHERE length(text) > 100 UNION ALL
SELECT 3, 'distinct', 'done', count(*), CAST(coalesce(sum(length(text)), 0) AS BIGINT), count(*) FILTER (WHERE length(text) < 200) FROM (SELECT DISTINCT text FROM documents WHERE length(text) > 100)""")
def stage_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of stages over the documents, whose figures come from the plans that wrote them; one is left out."""
    stages = [
        ("read", lambda d: d.select("doc_id", "text")), ("translate", lambda d: None), ("filled", lambda d: d.where(F.length("text") > 100)), ("distinct", lambda d: d.dropDuplicates(["text"]))]
    _, account = run_stages(table(spark, sf_dir, "documents"), stages, {"characters": F.sum(F.length("text")), "short": F.count_if(F.length("text") < 200)})
    figure = lambda c: F.coalesce(c, F.lit(0))
    return account.select("position", "stage", "status", figure(F.col("rows")).alias("rows"), figure(F.col("figures")["characters"]).alias("characters"), figure(F.col("figures")["short"]).alias("short"))


@query()
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_hits(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 6 * 3600.0)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored result for each assistant's turn; a third expired."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    until = F.when(F.col("turn") % 3 == 0, "2024-01-01").otherwise("2025-01-01").cast("timestamp")
    request = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select(request.alias("request_id"), F.to_json(F.struct(F.lit("refusal").alias("type"), F.lit("no_evidence").alias("reason"), F.col("text").alias("message"))).alias("result"), until.alias("expires_at"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN text END AS message FROM conversations")
def messages_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("request_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return history.with_results(c, _results(spark, sf_dir), "2024-06-01 00:00:00").select("conv_id", "turn", F.get_json_object("result", "$.message").alias("message"))


@query("SELECT conv_id, turn, text AS message FROM conversations WHERE role = 'assistant' AND turn % 3 <> 0")
def case_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"))
    return history.case_items(c, _results(spark, sf_dir), "2024-06-01 00:00:00").select("conv_id", "turn", F.get_json_object("result", "$.message").alias("message"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'refusal' ELSE 'missing' END AS kind, CASE WHEN role = 'assistant' THEN 'Reason: no_evidence' || chr(10) || text ELSE 'No stored result for request_id=' || conv_id || '-' || turn END AS lines FROM conversations""")
def dossier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"))
    return history.dossier_items(c, _results(spark, sf_dir)).select("conv_id", "turn", "kind", F.array_join("lines", "\n").alias("lines"))


@query("""WITH a AS (SELECT user_id AS k, max(ts) AS t FROM events WHERE event_id % 2 = 0 GROUP BY user_id), b AS (SELECT user_id AS k, max(ts) AS t FROM events WHERE event_id % 2 = 1 GROUP BY user_id), m AS (SELECT k, max(t) AS t FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k)
SELECT k, CASE WHEN k IN (SELECT k FROM a) THEN 'old' ELSE 'new' END AS title, CAST(floor(epoch(t)) AS BIGINT) AS updated, CAST(floor(epoch(t)) AS BIGINT) + 30 * 86400 AS expires FROM m""")
def conversation_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events made the conversations, odd ones are new activity."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", F.col("ts").cast("timestamp").alias("at"))
    old = e.where("event_id % 2 = 0").groupBy("k").agg(F.max("at").alias("updated_at")).withColumn("title", F.lit("old")).withColumn("expires_at", history.expires_at(F.col("updated_at")))
    out = history.touch(old, e.where("event_id % 2 = 1").select("k", F.lit("new").alias("title"), "at"), "k")
    return out.select("k", "title", F.unix_seconds("updated_at").alias("updated"), F.unix_seconds("expires_at").alias("expires"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'unknown_request' ELSE 'known' END AS reason FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) ON o_orderkey = l_orderkey")
def escalation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    known, rejected = history.unknown_requests(lines, table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return known.withColumn("reason", F.lit("known")).unionByName(rejected)


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS i, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 7 <> 0) SELECT c, i, CASE WHEN c % 2 = 0 THEN CAST(n + 1 - p AS INTEGER) ELSE p END AS position FROM o""")
def case_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh item is removed; even cases ask for the reverse order, odd ones for an order that isn't one."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("i"))
    kept = history.remove_items(o, o.where("i % 7 = 0"), ["c", "i"]).withColumn("position", F.row_number().over(Window.partitionBy("c").orderBy("i")))
    items = F.reverse(F.array_sort(F.collect_list("i")))
    wanted = kept.groupBy("c").agg(F.when(F.col("c") % 2 == 0, items).otherwise(F.slice(items, 1, 1)).alias("items")).where(F.size("items") > 0)
    wanted = wanted.where("c % 2 = 0").unionByName(wanted.where("c % 2 = 1").withColumn("items", F.transform("items", lambda x: -x)))
    return history.reorder(kept, wanted, "c", "i").select("c", "i", "position")


@query("SELECT page_id, CAST(CASE WHEN page_id % 4 = 0 THEN 'https://docs.example.org/laws/en/a.pdf' WHEN page_id % 4 = 1 THEN 'https://docs.example.org/laws/en/b.PDF' END AS VARCHAR) AS url, CASE page_id % 4 WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'none' END AS error FROM pages")
def single_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page gets links of its own: one PDF, two of which one bears the title, two that don't, or none."""
    k = F.col("page_id") % 4
    a = '<a href="/laws/en/a.pdf">A</a><a href="/laws/fr/c.pdf">C</a><a href="https://other.org/laws/en/d.pdf">D</a>'
    html = F.when(k == 0, a).when(k == 1, a + '<a href="https://docs.example.org/laws/en/b.PDF">the TITLE</a>').when(k == 2, a + '<a href="//docs.example.org/laws/en/e.pdf">E</a>').otherwise('<a href="x.html">X</a>')
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("https://docs.example.org/details/1").alias("url"), F.lit("The title").alias("title"), html.alias("html"))
    return files.single_candidate(files.anchors(pages, "page_id", "html"), pages, "page_id", "docs.example.org", "/laws/en/")


@query("SELECT source AS id FROM (SELECT DISTINCT source FROM documents) WHERE source IN ('src1', 'src2') OR source NOT IN ('src1', 'src2', 'src3', 'src4')")
def pending_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources are committed, two more with another digest."""
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.sha2("source", 256).alias("sha256")).distinct()
    done = s.where("id IN ('src1', 'src2', 'src3', 'src4')").withColumn("sha256", F.when(F.col("id").isin("src1", "src2"), "old").otherwise(F.col("sha256")))
    return files.pending_sources(s, done).select("id")


@query("""WITH s AS (SELECT c_mktsegment AS source, c_custkey, c_custkey % 4 AS k FROM customer), e AS (SELECT source, c_custkey - 1 AS dst FROM s WHERE k = 3)
SELECT source, count(*) AS sections, CAST(count(*) FILTER (WHERE k = 3) AS BIGINT) AS edges, count(*) FILTER (WHERE k = 1) AS unlocated, count(*) FILTER (WHERE k = 2 AND NOT EXISTS (SELECT 1 FROM e WHERE e.source = s.source AND e.dst = s.c_custkey)) AS orphans, CAST(0 AS BIGINT) AS warnings FROM s GROUP BY source""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "source")
    key = lambda n: F.concat(F.lit("k"), n.cast("string"), F.lit("-proviso"))
    sections = c.select("source", F.when(k % 4 == 2, key(k)).otherwise(k.cast("string")).alias("key"), (k % 4 != 1).alias("has_box"))
    edges = c.where("c_custkey % 4 = 3").select("source", key(k - 1).alias("dst"), F.lit("proviso_of").alias("kind"))
    return files.ingest_report(sections, edges, spark.createDataFrame([], "source string"), c.select("source"))


@query("""WITH s AS (SELECT conv_id, turn, turn = 5 AS failed FROM conversations), f AS (SELECT conv_id, min(turn) AS stop FROM s WHERE failed GROUP BY conv_id), k AS (SELECT s.conv_id, s.turn, s.failed, f.stop FROM s LEFT JOIN f ON f.conv_id = s.conv_id WHERE f.stop IS NULL OR s.turn <= f.stop), m AS (SELECT conv_id, max(turn) AS t, max(stop) AS stop FROM k GROUP BY conv_id)
SELECT conv_id, turn AS seq, CASE WHEN failed THEN 'error' ELSE 'stage' END AS event FROM k UNION ALL SELECT conv_id, t + 1, 'result' FROM m WHERE stop IS NULL UNION ALL SELECT conv_id, t + 2, 'done' FROM m""")
def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("role").alias("stage"), F.when(F.col("turn") == 5, "failed").otherwise("ok").alias("status"), F.col("text").alias("payload"))
    return files.stage_events(c, "conv_id").select("conv_id", "seq", "event")


@query("SELECT conv_id, CAST(sum(CASE WHEN turn % 4 <> 3 THEN length(text) ELSE 0 END) AS BIGINT) AS total, count(*) FILTER (WHERE turn % 4 = 3) AS skipped FROM conversations GROUP BY conv_id")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("string").alias("stage"), F.when(F.col("turn") % 4 == 3, "skipped").otherwise("ok").alias("status"), F.length("text").cast("bigint").alias("ms"))
    return files.stage_timings(c, "conv_id").select("conv_id", "total", "skipped")


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + 7 * 86400 AS next_check, ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20 00:00:00' AS due FROM events")
def monitor_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", files.next_check(F.col("ts").cast("timestamp")).alias("n"))
    return e.select("event_id", F.unix_seconds("n").alias("next_check"), files.due(F.col("n"), "2024-01-20 00:00:00").alias("due"))


@query("SELECT side, count(*) AS n FROM (SELECT 'left' AS side FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'right' FROM orders WHERE o_orderkey % 10 = 1) GROUP BY side")
def checklist_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return files.differing(o.where("o_orderkey % 10 <> 1"), o.where("o_orderkey % 10 <> 0")).groupBy("side").agg(F.count("*").alias("n"))

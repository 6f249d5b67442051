"""Queries of assessments: risk cards, category support, checklists, citations, matches with known formulations, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import assessments as am
from attesta.operators import chunking, graph, rules
from attesta.plans import corpus
from attesta.plans.chunk_sql import CHUNK_COUNTS, HEADS
from attesta.plans.corpus import C_CHUNKS
from attesta.plans.text import _FACTS, _facts
from attesta.session import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {_FACTS}, dims AS (SELECT unnest(['3(p)', '3(e)', '3(d)']) AS section, unnest([0, 1, 2]) AS position), s AS (SELECT fact_id, section, round(sum(weight), 6) AS score, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM hits GROUP BY fact_id, section)
SELECT f.fact_id, d.section, coalesce(s.score, 0.0) AS score, CASE WHEN coalesce(s.score, 0) >= 0.67 THEN 'high' WHEN coalesce(s.score, 0) >= 0.34 THEN 'medium' ELSE 'low' END AS risk, coalesce(rules, '') AS rules, CASE WHEN s.score IS NULL THEN '' ELSE 'patents_act_1970#s' || d.section END AS cites
FROM facts f CROSS JOIN dims d LEFT JOIN s ON s.fact_id = f.fact_id AND s.section = d.section""")
def risk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = am.risk_sections(_facts(spark, sf_dir), rules.PATENT_RISK, "fact_id")
    return s.select("fact_id", "section", "score", "risk", F.array_join("rules", ",").alias("rules"), F.array_join("cites", ",").alias("cites"))


@query(f"""WITH {_FACTS}, s AS (SELECT f.fact_id, coalesce(sum(weight) FILTER (WHERE section = '3(p)'), 0) AS p, coalesce(sum(weight) FILTER (WHERE section = '3(e)'), 0) AS e, coalesce(sum(weight) FILTER (WHERE section = '3(d)'), 0) AS d FROM facts f LEFT JOIN hits h ON h.fact_id = f.fact_id GROUP BY f.fact_id), t AS (SELECT *, round(least(1.0, p + e + d), 6) AS score FROM s), g AS (SELECT *, CASE WHEN score >= 0.67 THEN 'high' WHEN score >= 0.34 THEN 'medium' ELSE 'low' END AS gauge FROM t)
SELECT fact_id, CAST(score AS DOUBLE) AS score, gauge, CAST(d >= 0.34 AS INTEGER) + CAST(p >= 0.34 AS INTEGER) AS n_help,
  'n_3p-' || CASE WHEN p > 0 THEN 'yes' ELSE 'no' END || '>n_3e-' || CASE WHEN e > 0 THEN 'yes' ELSE 'no' END || '>n_3d-' || gauge || '>outcome' AS path FROM g""")
def risk_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = am.risk_card(_facts(spark, sf_dir), rules.PATENT_RISK, "fact_id")
    steps = F.transform("path.edges", lambda e: F.concat(e["src"], F.lit("-"), e["label"], F.lit(">")))
    return card.select("fact_id", "score", "gauge", F.size("help").alias("n_help"), F.concat(F.array_join(steps, ""), F.element_at(F.transform("path.edges", lambda e: e["dst"]), -1)).alias("path"))


#: Sections of two acts from the corpus's lines: every document is a section tree of one of the acts.
_ACT = f"""{C_CHUNKS}, named AS (SELECT chunk_id, doc_id, line, text, jurisdiction, valid_from, valid_to, CASE WHEN doc_id % 2 = 0 THEN 'biological_diversity_act_2002' ELSE 'drugs_cosmetics_act_1940' END || '#s' || CAST(doc_id % 45 AS VARCHAR) || CASE line % 3 WHEN 0 THEN '' WHEN 1 THEN '(a)' ELSE '-proviso' END AS section_key FROM c_chunks WHERE version = 'live')"""


def _act(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.chunks(spark, sf_dir).where("version = 'live'")
    line = F.col("line") % 3
    key = F.concat(F.when(F.col("doc_id") % 2 == 0, am.ABS_ACT).otherwise("drugs_cosmetics_act_1940"), F.lit("#s"), (F.col("doc_id") % 45).cast("string"), F.when(line == 0, "").when(line == 1, "(a)").otherwise("-proviso"))
    return c.withColumn("section_key", key)


@query(f"""WITH {_ACT}, asked AS (SELECT r AS request_id, 'biological_diversity_act_2002#s' || CAST(n AS VARCHAR) AS cite, DATE '2021-01-01' + CAST(r * 100 AS INTEGER) AS as_of, CASE WHEN r % 2 = 0 THEN ['IN'] ELSE ['IN', 'INTL'] END AS js FROM range(4) a(r), (SELECT unnest([3, 7, 6, 4, 20, 40]) AS n) b)
SELECT request_id, cite, section_key, 'ev_' || substr(sha256(chunk_id || ':0:' || CAST(length(text) AS VARCHAR)), 1, 12) AS evidence_id FROM asked JOIN named ON section_key = cite OR starts_with(section_key, cite || '(') OR starts_with(section_key, cite || '-') WHERE list_contains(js, jurisdiction) AND valid_from <= as_of AND (valid_to IS NULL OR valid_to > as_of)""")
def citation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("request_id", "cite", "section_key", "evidence_id")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.range(4).withColumnRenamed("id", "request_id")
    asked = r.select("request_id", F.explode(F.array(*[F.lit(f"{am.ABS_ACT}#s{n}") for n in ("3", "7", "6", "4", "20", "40")])).alias("cite"), F.date_add(F.lit("2021-01-01").cast("date"), (F.col("request_id") * 100).cast("int")).alias("as_of"), F.when(F.col("request_id") % 2 == 0, F.array(F.lit("IN"))).otherwise(F.array(F.lit("IN"), F.lit("INTL"))).alias("jurisdictions"))
    act = _act(spark, sf_dir)
    sections = act.select("section_key", F.col("chunk_id").alias("section_id"), F.col("doc_id").alias("document_id"))
    chunks = act.select(F.col("chunk_id").alias("section_id"), "chunk_id", "jurisdiction", "valid_from", "valid_to", F.lit(0).alias("char_start"), F.length("text").alias("char_end"))
    documents = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("Act").alias("title"))
    return am.resolve_citations(asked, sections, chunks, documents, descendants=True)


@query(f"""WITH {_ACT}, req AS (SELECT r AS request_id, CASE r WHEN 0 THEN ['research'] WHEN 1 THEN ['ipr_application', 'export'] WHEN 2 THEN ['cultivation_trade', 'transfer_results'] ELSE ['other'] END AS a, DATE '2021-01-01' + CAST(r * 100 AS INTEGER) AS as_of, CASE WHEN r % 2 = 0 THEN ['IN'] ELSE ['IN', 'INTL'] END AS js FROM range(4) t(r)),
topics AS (SELECT unnest(['access', 'access', 'ipr', 'transfer', 'transfer', 'trade', 'trade']) AS topic, unnest([3, 7, 6, 4, 20, 7, 40]) AS n, unnest([['research', 'commercial_utilisation'], ['research', 'commercial_utilisation'], ['ipr_application'], ['transfer_results', 'export'], ['transfer_results', 'export'], ['cultivation_trade'], ['cultivation_trade']]) AS acts),
raised AS (SELECT request_id, topic, 'biological_diversity_act_2002#s' || CAST(n AS VARCHAR) AS cite, as_of, js FROM req JOIN topics ON list_has_any(a, acts)),
met AS (SELECT r.request_id, r.topic, 'ev_' || substr(sha256(chunk_id || ':0:' || CAST(length(text) AS VARCHAR)), 1, 12) AS e FROM raised r LEFT JOIN named ON (section_key = cite OR starts_with(section_key, cite || '(') OR starts_with(section_key, cite || '-')) AND list_contains(js, jurisdiction) AND valid_from <= as_of AND (valid_to IS NULL OR valid_to > as_of))
SELECT request_id, topic, count(DISTINCT e) AS n_spans, sha256(coalesce(string_agg(DISTINCT e, ',' ORDER BY e), '')) AS spans_sha256 FROM met GROUP BY request_id, topic""")
def abs_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("request_id")
    activities = F.when(k == 0, F.array(F.lit("research"))).when(k == 1, F.array(F.lit("ipr_application"), F.lit("export"))).when(k == 2, F.array(F.lit("cultivation_trade"), F.lit("transfer_results"))).otherwise(F.array(F.lit("other")))
    requests = spark.range(4).withColumnRenamed("id", "request_id").withColumn("activities", activities)
    spans = _cited(spark, sf_dir).select("request_id", "section_key", "evidence_id").distinct()
    out = am.abs_checklist(requests, spans, "request_id")
    return out.select("request_id", "topic", F.size("evidence_ids").cast("bigint").alias("n_spans"), F.sha2(F.array_join("evidence_ids", ",").cast("binary"), 256).alias("spans_sha256"))


@query("""WITH c AS (SELECT o_orderkey, (['classical', 'proprietary', 'cosmetic', 'new_drug'])[o_orderkey % 4 + 1] AS category FROM orders), d AS (SELECT * FROM (VALUES ('classical', 'drugs_cosmetics_act_1940#s3(a)'), ('proprietary', 'drugs_cosmetics_act_1940#s3(h)(i)'), ('cosmetic', 'drugs_cosmetics_act_1940#s3(aaa)')) t(category, k)),
e AS (SELECT DISTINCT l_orderkey, CASE l_linenumber WHEN 1 THEN 'drugs_cosmetics_act_1940#s3(a)' WHEN 2 THEN 'drugs_cosmetics_act_1940#s3' WHEN 3 THEN 'drugs_cosmetics_act_1940#s3(aaa)' ELSE 'x' END AS k FROM lineitem)
SELECT o_orderkey, category, EXISTS (SELECT 1 FROM d JOIN e ON e.k = d.k WHERE d.category = c.category AND e.l_orderkey = c.o_orderkey) AS supported FROM c""")
def category_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(n == 1, "drugs_cosmetics_act_1940#s3(a)").when(n == 2, "drugs_cosmetics_act_1940#s3").when(n == 3, "drugs_cosmetics_act_1940#s3(aaa)").otherwise("x").alias("section_key"))
    kinds = F.array(*map(F.lit, ["classical", "proprietary", "cosmetic", "new_drug"]))
    c = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("category"))
    return am.category_support(c, evidence, "o_orderkey")


_FORMULAS = """f AS (SELECT l_orderkey AS k, list(DISTINCT p_brand ORDER BY p_brand) AS b, list(DISTINCT split_part(p_type, ' ', 1) ORDER BY split_part(p_type, ' ', 1)) AS t FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey), known AS (SELECT p_partkey % 200 AS ref, list(DISTINCT p_brand ORDER BY p_brand) AS b, list(DISTINCT p_type ORDER BY p_type) AS i FROM part GROUP BY p_partkey % 200)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 200).alias("ref")).agg(F.array_sort(F.collect_set("p_brand")).alias("items"), F.array_sort(F.collect_set("p_type")).alias("indications"))


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("t"))
    o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("items"), F.array_sort(F.collect_set("t")).alias("t"))
    return o.select(F.col("l_orderkey").alias("ask"), "items", F.lower(F.element_at("t", 1)).alias("indication"))


@query(f"""WITH {_FORMULAS}, x AS (SELECT f.k AS ask, ref, f.b AS ab, known.b AS rb, len(list_intersect(f.b, known.b)) AS m, contains(lower(array_to_string(i, '|')), lower(f.t[1])) AS boost FROM f JOIN known ON list_has_any(f.b, known.b) WHERE f.k % 50 = 0), s AS (
  SELECT *, round(least(1.0, CAST(m AS DOUBLE) / (len(ab) + len(rb) - m) + CASE WHEN boost THEN 0.15 ELSE 0 END), 2) AS score FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, ref) AS rank FROM s)
SELECT ask, ref, score, CAST(rank AS INTEGER) AS rank, array_to_string(list_sort(list_intersect(ab, rb)), ',') AS overlap, array_to_string(list_sort(list_filter(rb, lambda y: NOT list_contains(ab, y))), ',') AS missing, array_to_string(list_sort(list_filter(ab, lambda y: NOT list_contains(rb, y))), ',') AS extra, boost AS indication_match FROM r WHERE rank <= 8""")
def formulation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked are the orders whose key is divisible by 50, a search's query set, against all known formulations."""
    m = am.formulation_matches(_formulas(spark, sf_dir).where("ask % 50 = 0"), _known(spark, sf_dir))
    return m.select("ask", "ref", "score", "rank", *[F.array_join(c, ",").alias(c) for c in ("overlap", "missing", "extra")], "indication_match")


@query()
def tk_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _formulas(spark, sf_dir).where("ask % 50 = 0").select("ask", F.transform("items", lambda b: F.when(b == "Brand#11", "unknown herb").otherwise(F.upper(b))).alias("items"), "indication")
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct().withColumn("canonical", F.col("name"))
    cases = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("case")).agg(F.array_sort(F.collect_set("p_brand")).alias("species"))
    r = am.tk_radar(asked, names, _known(spark, sf_dir), cases)
    return r.select("ask", F.array_join("canonical", ",").alias("canonical"), F.array_join("terms", ",").alias("terms"), F.array_join(F.transform("matches", lambda m: F.concat(m["ref"].cast("string"), F.lit("="), m["score"].cast("string"))), ",").alias("matches"), F.array_join(F.transform("watchlist", lambda w: w.cast("string")), ",").alias("watchlist"))


@query("""SELECT o_orderkey, c AS name, c AS canonical FROM (SELECT o_orderkey, unnest([upper(o_orderpriority), 'nothing']) AS n FROM orders) JOIN (SELECT DISTINCT o_orderpriority AS c FROM orders) ON lower(c) = lower(n)""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    names = o.select(F.col("o_orderpriority").alias("name")).distinct().withColumn("canonical", F.col("name"))
    got = am.canonical_names(o.select("o_orderkey", F.explode(F.array(F.upper("o_orderpriority"), F.lit("nothing"))).alias("name")), names, "o_orderkey")
    return got.select("o_orderkey", F.col("canonical").alias("name"), "canonical")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as it is, a page for each of its lines; before them, by its id, a page with sections, articles, rules or nothing."""
    k = F.col("doc_id") % 4
    head = F.when(k == 0, F.array(F.lit(HEADS[0]))).when(k == 1, F.array(F.lit(HEADS[1]))).when(k == 2, F.array(F.lit(HEADS[2]))).otherwise(F.array().cast("array<string>"))
    pages = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.when(k == 2, "rule").otherwise("statute").alias("doc_type"), F.posexplode(F.concat(head, F.split(F.coalesce("text", F.lit("")), "\n"))).alias("page", "raw"))
    return pages.withColumn("printed", F.col("page") + 1)


@query()
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all documents."""
    units, _, _ = chunking.chunk_documents(_pages(spark, sf_dir))
    return units.select("doc", "key", "parent", F.array_join("path", " > ").alias("path"), "start", "end", "page_start", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(CHUNK_COUNTS)
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its units and edges; it has units if it has text; each unit's text is what the document holds at its offsets; each unit's parent is a unit."""
    pages, documents = chunking.stored(_pages(spark, sf_dir))
    units, edges, _ = chunking.cut_documents(pages, documents)
    held = units.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "text", "key", "parent")).alias("u"), F.count("*").alias("n_u"))
    keys = F.transform("u", lambda u: u["key"])
    at_home = F.forall("u", lambda u: F.substr("full", u["start"] + 1, u["end"] - u["start"]) == u["text"])
    found = documents.select("doc", "full").join(held, "doc", "left").join(edges.groupBy("doc").agg(F.count("*").alias("n_e")), "doc", "left")
    counts = [F.coalesce("n_u", F.lit(0)).alias("n_units"), F.coalesce("n_e", F.lit(0)).alias("n_edges")]
    return found.select("doc", *counts, F.col("u").isNotNull().alias("has_units"), F.coalesce(at_home, F.lit(True)).alias("verbatim"), F.coalesce(F.forall("u", lambda u: u["parent"].isNull() | F.array_contains(keys, u["parent"])), F.lit(True)).alias("known_parents"))


_PARTS = f"""{C_CHUNKS}, u AS (SELECT doc_key AS doc, chunk_id || CASE line % 3 WHEN 1 THEN '-proviso' WHEN 2 THEN '-explanation' ELSE '' END AS key, line FROM c_chunks),
e AS (SELECT doc_key AS doc, chunk_id AS src, doc_key || '#s' || CAST(line + 1 AS VARCHAR) || CASE WHEN line % 2 = 0 THEN '-proviso' ELSE '-explanation' END AS dst FROM c_chunks)"""


@query(f"WITH {_PARTS} SELECT doc, key FROM u WHERE line % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.dst = u.key)")
def orphan_provisos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.chunks(spark, sf_dir)
    line = F.col("line")
    keys = c.select(F.concat("chunk_id", F.when(line % 3 == 1, "-proviso").when(line % 3 == 2, "-explanation").otherwise("")).alias("key"), "doc_key")
    edges = c.select(F.concat("doc_key", F.lit("#s"), (line + 1).cast("string"), F.when(line % 2 == 0, "-proviso").otherwise("-explanation")).alias("dst"), F.lit("proviso_of").alias("kind"))
    return graph.orphan_parts(keys, edges, "key").select(F.regexp_extract("key", "^([^#]*)#", 1).alias("doc"), "key")


@query(f"""WITH {C_CHUNKS}, p AS (SELECT a.chunk_id, b.chunk_id AS up FROM c_chunks a LEFT JOIN c_chunks b ON b.doc_key = a.doc_key AND b.line = a.line // 2 AND a.line > 0)
SELECT chunk_id, substr(sha256(split_part(chunk_id, '#', 1) || '|' || chunk_id), 1, 32) AS section_id, CASE WHEN up IS NOT NULL THEN substr(sha256(split_part(up, '#', 1) || '|' || up), 1, 32) END AS parent_id FROM p""")
def load_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.chunks(spark, sf_dir)
    line = F.col("line")
    units = c.select(F.col("doc_key").alias("doc"), F.col("chunk_id").alias("key"), F.when(line > 0, F.concat("doc_key", F.lit("#s"), F.floor(line / 2).cast("string"))).alias("parent"))
    edges = c.select(F.col("doc_key").alias("doc"), F.col("chunk_id").alias("src"), F.concat("chunk_id", F.lit("x")).alias("dst"), F.lit("refers_to").alias("kind"))
    return graph.load_sections(units, edges)[0].select(F.col("key").alias("chunk_id"), "section_id", "parent_id")

"""Queries of claims and evidence: each question of the benchmark gets a pack of chunks, and claims that cite it.

Claims are made from the pack by a fixed rule, so that SQL can follow: claim c of a question cites the spans E(c) and E(c + 1),
every fifth names a span that isn't there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import language as lg, payload as pl, routing, text as tx
from attesta.operators import claims as cl
from attesta.operators import ranking
from attesta.plans import corpus
from attesta.plans.corpus import C_CHUNKS
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


#: The pack of a document: its lines in order, each a span; the document's id is the query's.
_PACK = f"""{C_CHUNKS}, pack AS (
  SELECT doc_id AS query_id, line + 1 AS number, 'ev_' || substr(sha256(chunk_id || ':0:' || CAST(length(text) AS VARCHAR)), 1, 12) AS evidence_id, CASE WHEN line % 7 = 6 THEN 'INTL' ELSE jurisdiction END AS jurisdiction, doc_key AS doc_id, version AS corpus_version,
         doc_key || '#s' || CAST(line // 4 AS VARCHAR) || CASE WHEN line % 4 > 0 THEN '(' || CAST(line % 4 AS VARCHAR) || ')' ELSE '' END AS section_key,
         CASE WHEN line % 4 > 0 THEN ['S' || CAST(line // 4 AS VARCHAR), 'C' || CAST(line % 4 AS VARCHAR)] ELSE ['S' || CAST(line // 4 AS VARCHAR)] END AS section_path, 'Act 1970 — s.' || CAST(line // 4 AS VARCHAR) AS citation_label, text
  FROM c_chunks
)"""
_CLAIMS = _PACK + """, claims AS (
  SELECT query_id, number AS claim_no, CASE number % 5 WHEN 0 THEN ['E' || CAST(number AS VARCHAR), 'x9'] ELSE ['e' || CAST(number AS VARCHAR), ' E' || CAST(number + 1 AS VARCHAR) || ' '] END AS evidence_ids, number, section_key FROM pack
), refs AS (
  SELECT query_id, claim_no, pos, regexp_extract(trim(evidence_ids[pos + 1], ' '), '(?i)^E(\\d+)$', 1) AS n FROM claims, range(2) r(pos)
), met AS (
  SELECT r.query_id, claim_no, bool_and(p.evidence_id IS NOT NULL) AS found, list(p.evidence_id ORDER BY pos) AS ids, count(DISTINCT p.jurisdiction) AS js, min(p.jurisdiction) AS j FROM refs r LEFT JOIN pack p ON p.query_id = r.query_id AND CAST(p.number AS VARCHAR) = r.n GROUP BY r.query_id, claim_no
), resolved AS (
  SELECT query_id, claim_no, CASE WHEN NOT found THEN 'unknown_reference' WHEN js > 1 THEN 'mixed_jurisdictions' END AS dropped, CASE WHEN found AND js = 1 THEN ids END AS ids, CASE WHEN found AND js = 1 THEN j END AS jurisdiction FROM met
)"""


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.chunks(spark, sf_dir)
    section, clause = F.floor(F.col("line") / 4).cast("string"), (F.col("line") % 4).cast("string")
    inner = F.col("line") % 4 > 0
    return c.select(
        F.col("doc_id").alias("query_id"), (F.col("line") + 1).alias("number"), tx.evidence_id(F.col("chunk_id"), F.lit(0), F.length("text")).alias("evidence_id"), F.when(F.col("line") % 7 == 6, "INTL").otherwise(F.col("jurisdiction")).alias("jurisdiction"),
        F.col("doc_key").alias("doc_id"), F.col("version").alias("corpus_version"), F.concat("doc_key", F.lit("#s"), section, F.when(inner, F.concat(F.lit("("), clause, F.lit(")"))).otherwise("")).alias("section_key"),
        F.when(inner, F.array(F.concat(F.lit("S"), section), F.concat(F.lit("C"), clause))).otherwise(F.array(F.concat(F.lit("S"), section))).alias("section_path"), F.concat(F.lit("Act 1970 — s."), section).alias("citation_label"), "text",
    )


def _claims(pack: DataFrame) -> DataFrame:
    n = F.col("number")
    e = lambda k: F.concat(F.lit("E"), k.cast("string"))
    ids = F.when(n % 5 == 0, F.array(e(n), F.lit("x9"))).otherwise(F.array(F.lower(e(n)), F.concat(F.lit(" "), e(n + 1), F.lit(" "))))
    statement = F.concat(F.lit("Under the Act 1970 "), F.regexp_replace("section_key", r"^.*#s", "section "), F.when(n % 3 == 0, " within 30 days").otherwise(""))
    return pack.select("query_id", n.alias("claim_no"), statement.alias("statement"), ids.alias("evidence_ids"), ((n * 37 % 101) / 100.0).alias("entailment"))


@query(f"WITH {_CLAIMS} SELECT query_id, claim_no, dropped, jurisdiction, array_to_string(ids, ',') AS evidence FROM resolved")
def claim_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = _pack(spark, sf_dir)
    return cl.resolve_claims(_claims(pack), pack).select("query_id", "claim_no", "dropped", "jurisdiction", F.array_join("resolved", ",").alias("evidence"))


_PARENTS = """, parents AS (
  SELECT DISTINCT c.query_id, c.evidence_id, p.evidence_id AS parent, len(p.section_path) AS depth FROM pack c JOIN pack p ON p.query_id = c.query_id AND p.jurisdiction = c.jurisdiction AND p.corpus_version = c.corpus_version AND p.doc_id = c.doc_id
    AND len(p.section_path) < len(c.section_path) AND p.section_path = c.section_path[1:len(p.section_path)] AND p.section_key <> c.section_key
)"""


@query(f"WITH {_PACK}{_PARENTS} SELECT query_id, evidence_id, parent, CAST(depth AS INTEGER) AS depth FROM parents")
def pack_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.ancestor_pairs(_pack(spark, sf_dir)).distinct()


@query(f"""WITH {_CLAIMS}{_PARENTS}, own AS (SELECT query_id, claim_no, unnest(ids) AS evidence_id, unnest(range(2)) AS pos FROM resolved WHERE dropped IS NULL), items AS (
  SELECT o.query_id, o.claim_no, o.pos, p.depth AS k, p.parent AS id FROM own o JOIN parents p ON p.query_id = o.query_id AND p.evidence_id = o.evidence_id UNION ALL SELECT query_id, claim_no, pos, 99, evidence_id FROM own
), firsts AS (SELECT query_id, claim_no, id, min(pos * 100 + k) AS o FROM items GROUP BY query_id, claim_no, id)
SELECT query_id, claim_no, string_agg(id, ',' ORDER BY o) AS cited FROM firsts GROUP BY query_id, claim_no""")
def claim_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = _pack(spark, sf_dir)
    return cl.with_parents(cl.resolve_claims(_claims(pack), pack), pack).select("query_id", "claim_no", F.array_join("cited", ",").alias("cited"))


def _verified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Checked claims and the packs, both stored: each is read several times, and neither lines nor verdicts are made again."""
    pack = materialize(_pack(spark, sf_dir), "packs")
    checked = cl.verify_claims(cl.with_parents(cl.resolve_claims(_claims(pack), pack), pack), pack)
    return materialize(checked.select("query_id", "claim_no", "statement", "entailment", "cited", "verdict"), "verified"), pack


@query()
def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir)[0].select("query_id", "claim_no", "verdict")


@query()
def verification_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cl.verification_outcome(_verified(spark, sf_dir)[0])
    return out.withColumn("drop_reasons", F.array_join(F.transform(F.map_entries("drop_reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query()
def answer_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified, pack = _verified(spark, sf_dir)
    asked = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.array(F.lit("IN"), F.lit("INTL")).alias("jurisdictions"), F.array(F.lit("gap")).alias("gaps"))
    s = cl.answer_sections(verified, pack, asked)
    return s.select("query_id", "jurisdiction", "position", F.size("claims").alias("n_claims"), F.sha2(F.array_join("claims", "\n").cast("binary"), 256).alias("claims_sha256"), F.size("gaps").alias("n_gaps"))


@query()
def answer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole answers in the documents' languages: sections, spans behind the claims, and glossed terms."""
    verified, pack = _verified(spark, sf_dir)
    asked = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "lang", F.array("jurisdiction").alias("jurisdictions"), F.array(F.lit("gap")).alias("gaps"))
    terms = [("section", {"fr": "article", "de": "Paragraph", "es": "artículo"}), ("30 days", {"fr": "30 jours", "de": "30 Tage"}), ("proviso", {"fr": "réserve"})]
    a = cl.answers(verified, pack, asked, terms)
    shown = lambda s: F.concat(s["jurisdiction"], F.lit(":"), F.array_join(s["claims"], ";"), F.lit(":"), F.size(s["gaps"]).cast("string"))
    spans = F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["number"].cast("string"), F.lit(" "), e["value"]["section_key"]))
    return a.select("query_id", F.array_join(F.transform("sections", shown), "|").alias("sections"), F.array_join(spans, ",").alias("evidence"), F.array_join(F.transform("glossary", lambda g: F.concat(g["term"], F.lit("="), g["gloss"])), ",").alias("glossary"))


@query()
def cited_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified, pack = _verified(spark, sf_dir)
    return cl.cited_only(pack, verified, cl.nearest_sources(pack)).select("query_id", "number", "evidence_id")


@query(f"""WITH {_PACK} SELECT query_id, sha256(string_agg('[E' || CAST(number AS VARCHAR) || '] ' || citation_label || ' [' || jurisdiction || ']' || chr(10) || array_to_string(section_path, ' > ') || chr(10) || text, chr(10) || chr(10) ORDER BY number)) AS prompt_sha256 FROM pack GROUP BY query_id""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.prompts(_pack(spark, sf_dir)).select("query_id", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"))


@query(f"WITH {_PACK} SELECT query_id, number, array_to_string(section_path, ' > ') || chr(10) || text AS embed_text FROM pack")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir).select("query_id", "number", tx.embed_text(F.col("section_path"), F.col("text")).alias("embed_text"))


@query(f"""WITH {C_CHUNKS}, r AS (SELECT doc_id AS query_id, line + 1 AS number, chunk_id, CASE line % 3 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE line END AS page, CASE WHEN line % 2 = 0 THEN line + 10 END AS page_start, doc_key, line, text, doc_id FROM c_chunks WHERE line % 11 <> 10)
SELECT query_id, number, 'ev_' || substr(sha256(chunk_id || ':0:' || CAST(length(text) AS VARCHAR)), 1, 12) AS evidence_id, CASE WHEN line % 5 = 4 THEN 'T' || doc_key || ' — Head' ELSE 'T' || doc_key || ' — s.' || CAST(line AS VARCHAR) END AS citation_label,
  CAST(coalesce(nullif(r.page, 0), nullif(page_start, 0), 0) AS INTEGER) AS page, coalesce(p.url, 'u' || doc_key) AS source_url FROM r LEFT JOIN pages p ON p.page_id = r.doc_id""")
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.chunks(spark, sf_dir)
    line = F.col("line")
    ranked = c.select(F.col("doc_id").alias("query_id"), (line + 1).alias("rank"), "chunk_id", F.col("chunk_id").alias("section_id"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.when(line % 3 == 0, 0).when(line % 3 == 2, line).alias("page"), "text")
    sections = c.where(line % 11 != 10).select(F.col("chunk_id").alias("section_id"), F.col("doc_key").alias("document_id"), F.when(line % 5 == 4, F.concat("doc_key", F.lit("#x"), line.cast("string"))).otherwise(F.col("chunk_id")).alias("section_key"), F.array(F.lit("p")).alias("section_path"), F.lit("Head").alias("heading"), F.when(line % 2 == 0, line + 10).alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    d = corpus.documents(spark, sf_dir)
    documents = d.select(F.col("doc_key").alias("document_id"), "doc_id", F.concat(F.lit("T"), "doc_key").alias("title"), "jurisdiction", F.concat(F.lit("u"), "doc_key").alias("source_url"))
    artifacts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("artifact_url"))
    return cl.evidence_pack(ranked, sections, documents, artifacts).select("query_id", "number", "evidence_id", "citation_label", "page", "source_url")


@query(f"WITH {C_CHUNKS}, k AS (SELECT chunk_id, CAST(line AS VARCHAR) || CASE line % 3 WHEN 0 THEN '(a)(2)' WHEN 1 THEN 'A(b)' ELSE '' END AS c, line FROM c_chunks) SELECT chunk_id, CASE line % 3 WHEN 0 THEN 'section ' || line || ',section ' || line || '(a),section ' || line || '(a)(2)' WHEN 1 THEN 'section ' || line || 'a,section ' || line || 'a(b)' ELSE 'section ' || line END AS located FROM k")
def locator_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    key = F.concat("chunk_id", F.when(line % 3 == 0, "(a)(2)").when(line % 3 == 1, "A(b)").otherwise(""))
    return corpus.chunks(spark, sf_dir).select("chunk_id", F.array_join(tx.cited_locators(key), ",").alias("located"))


_LANG_WORDS = "\n".join(f"{k}|{'|'.join(v)}" for k, v in lg.WORDS.items())


def _language_sql() -> str:
    cols = []
    for k, words in lg.WORDS.items():
        letters = f" + len(regexp_extract_all(t, '[{lg.LETTERS[k]}]'))" if lg.LETTERS[k] else ""
        names = ", ".join(f"'{w}'" for w in words)
        cols.append(f"3 * len(list_filter(w, lambda x: list_contains([{names}], x))){letters} AS {k}")
    return f"""WITH d AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[\\p{{L}}]+') AS w FROM documents), s AS (SELECT doc_id, {', '.join(cols)} FROM d), m AS (SELECT *, greatest(en, fr, de, es) AS m FROM s)
SELECT doc_id, CASE WHEN CAST(en = m AS INTEGER) + CAST(fr = m AS INTEGER) + CAST(de = m AS INTEGER) + CAST(es = m AS INTEGER) > 1 THEN 'en' WHEN en = m THEN 'en' WHEN fr = m THEN 'fr' WHEN de = m THEN 'de' ELSE 'es' END AS lang FROM m"""


@query(_language_sql())
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lg.language(F.col("text"), ("en", "fr", "de", "es")).alias("lang"))


@query()
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.segments(F.col("text"), 1800).alias("s"))
    return d.select("doc_id", F.posexplode("s").alias("segment", "text")).select("doc_id", "segment", F.length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


_TERMS = [("the", {"fr": "le", "de": "der"}), ("and", {"fr": "et"}), ("tion", {"de": "ung"})]


@query("""WITH t AS (SELECT unnest(['the', 'and', 'tion']) AS term, unnest(['__TERM_0__', '__TERM_1__', '__TERM_2__']) AS k), d AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '(?i)the', '__TERM_0__', 'g'), '(?i)and', '__TERM_1__', 'g'), '(?i)tion', '__TERM_2__', 'g') AS masked FROM documents)
SELECT doc_id, masked, replace(replace(replace(masked, '__TERM_0__', 'the'), '__TERM_1__', 'and'), '__TERM_2__', 'tion') AS restored FROM d""")
def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.mask_terms(F.col("text"), [t for t, _ in _TERMS]).alias("m"))
    return d.select("doc_id", "m.masked", tx.unmask(F.col("m.masked"), F.col("m.restore")).alias("restored"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'the=le' END, CASE WHEN contains(lower(text), 'and') THEN 'and=et' END], lambda x: x IS NOT NULL), ',') AS glossary FROM documents")
def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tx.glossary(F.col("text"), _TERMS, "fr")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(g, lambda x: F.concat(x["term"], F.lit("="), x["gloss"])), ",").alias("glossary"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN left(text || chr(10) || role, 300) WHEN 1 THEN left(text, 300) WHEN 2 THEN 'answer' ELSE 'Result' END AS summary FROM conversations WHERE length(text) > 0")
def result_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = lambda t: F.struct(t.alias("text"))
    sections = F.array(F.struct(F.array(claim(F.col("text")), claim(F.col("role"))).alias("claims")))
    k = F.col("turn") % 4
    payload = F.when(k == 0, F.to_json(F.struct(sections.alias("sections")))).when(k == 1, F.to_json(F.struct(F.col("text").alias("message"), F.lit("x").alias("summary")))).when(k == 2, F.lit('{"type":"answer","message":""}')).otherwise("{}")
    return table(spark, sf_dir, "conversations").where(F.length("text") > 0).select("conv_id", "turn", F.substring(pl.result_summary(payload), 1, 300).alias("summary"))


@query("SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS balance, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'z' ELSE '' END AS unknown, c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AS valid FROM customer")
def payload_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    extra = F.when(k % 3 == 0, F.lit(',"z":1')).otherwise("")
    named = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(',"n":"'), "c_name", F.lit('"')))
    raw = F.concat(F.lit('{"a":{"balance":'), F.col("c_acctbal").cast("string"), F.lit('},"s":"'), "c_mktsegment", F.lit('"'), named, extra, F.lit("}"))
    c = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("p"))
    p = F.col("p")
    return c.select("c_custkey", pl.field_at(p, "a.balance", "double").alias("balance"), pl.field_at(p, "s").alias("segment"), F.array_join(pl.unknown_keys(p, ["a", "s", "n"]), ",").alias("unknown"), pl.valid_payload(p, "a struct<balance:double>, s string, n string", ["a", "s", "n"], ["a", "n"]).alias("valid"))


@query("SELECT doc_id, length(text) BETWEEN 1 AND 1000 AND doc_id % 15 BETWEEN 1 AND 12 AS ok FROM documents")
def claim_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 15), lambda i: i)
    return table(spark, sf_dir, "documents").select("doc_id", pl.within_bounds(F.col("text"), F.slice(ids, F.lit(1), (F.col("doc_id") % 15).cast("int"))).alias("ok"))


@query()
def context_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn, routed with the turn before it as context."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return c.withColumn("before", before).where("role = 'user'").select("conv_id", "turn", routing.route_with_context(F.col("text"), F.col("before")).alias("r")).select("conv_id", "turn", "r.intent", "r.section_key")


@query()
def scrubbed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested answers with personal data in texts; evidence stays as it is."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.array(F.struct(F.concat(F.lit("mail a.b@c.org "), "text").alias("text"))).alias("claims"), F.create_map(F.lit("note"), F.lit("call 9876543210"), F.lit("evidence"), F.lit("call 9876543210")).alias("extra"), F.array("text").alias("evidence")).alias("p"))
    out = pl.scrub_payload(d, ["p"])
    return out.select("doc_id", F.sha2(F.to_json("p").cast("binary"), 256).alias("sha256"), F.substring(F.col("p.claims")[0]["text"], 1, 12).alias("head"), F.col("p.extra")["note"].alias("note"), F.col("p.extra")["evidence"].alias("evidence_note"))

"""The versioned corpus that the queries run on, derived from the data tables, as DataFrames and as SQL views.

Documents get a jurisdiction, a type, a validity period and a corpus version from their ids; their
lines are the sections and chunks. Test items are the questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import table

#: Document types and kinds of edges.
DOC_TYPES = ["statute", "rule", "regulation", "notification", "treaty", "guideline", "form", "order"]
EDGE_KINDS = ["amends", "refers_to", "defined_in", "proviso_of", "exception_to"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    start = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1461).cast("int"))
    return d.select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_key"), F.when(F.col("lang") == "en", "IN").otherwise("INTL").alias("jurisdiction"),
        F.element_at(F.array(*map(F.lit, DOC_TYPES)), (F.col("doc_id") % 8 + 1).cast("int")).alias("doc_type"), start.alias("valid_from"), F.when(F.col("doc_id") % 3 == 0, F.date_add(start, 365)).alias("valid_to"),
        F.when(F.col("doc_id") % 10 == 9, "staged").otherwise("live").alias("version"), "lang", "source", "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of a document; chunk_id is the section key."""
    d = documents(spark, sf_dir).select("doc_id", "doc_key", "jurisdiction", "doc_type", "valid_from", "valid_to", "version", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return d.withColumn("chunk_id", F.concat("doc_key", F.lit("#s"), F.col("line").cast("string")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    kind = F.col("item_id") % 3
    return b.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.when(kind == 0, "IN").when(kind == 1, "INTL").otherwise("BOTH").alias("scope"),
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("item_id") * 17).cast("int")).alias("as_of"),
    )


def questions_by_jurisdiction(q: DataFrame) -> DataFrame:
    """BOTH becomes a row for either jurisdiction."""
    return q.withColumn("jurisdiction", F.explode(F.when(F.col("scope") == "BOTH", F.array(F.lit("IN"), F.lit("INTL"))).otherwise(F.array("scope"))))


_TYPES = ", ".join(f"'{t}'" for t in DOC_TYPES)
C_DOCUMENTS = f"""c_documents AS (
  SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) AS doc_key, CASE WHEN lang = 'en' THEN 'IN' ELSE 'INTL' END AS jurisdiction,
         ([{_TYPES}])[doc_id % 8 + 1] AS doc_type, CAST(DATE '2020-01-01' + CAST(doc_id % 1461 AS INTEGER) AS DATE) AS valid_from,
         CASE WHEN doc_id % 3 = 0 THEN CAST(DATE '2020-01-01' + CAST(doc_id % 1461 AS INTEGER) + 365 AS DATE) END AS valid_to,
         CASE WHEN doc_id % 10 = 9 THEN 'staged' ELSE 'live' END AS version, lang, source, text
  FROM documents
)"""
C_CHUNKS = (
    C_DOCUMENTS
    + """, c_lines AS (
  SELECT doc_id, doc_key, jurisdiction, doc_type, valid_from, valid_to, version, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM c_documents
), c_chunks AS (
  SELECT *, doc_key || '#s' || CAST(line AS VARCHAR) AS chunk_id FROM c_lines
)"""
)
C_QUESTIONS = r"""c_questions AS (
  SELECT item_id AS query_id, text AS question, CASE item_id % 3 WHEN 0 THEN 'IN' WHEN 1 THEN 'INTL' ELSE 'BOTH' END AS scope,
         CAST(DATE '2022-01-01' + CAST(item_id * 17 AS INTEGER) AS DATE) AS as_of
  FROM benchmark
), c_asked AS (
  SELECT *, unnest(CASE WHEN scope = 'BOTH' THEN ['IN', 'INTL'] ELSE [scope] END) AS jurisdiction FROM c_questions
)"""

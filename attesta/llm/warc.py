"""WARC derivative builder.

Responses become two linked records each: a metadata record that keeps the source's headers and
digests, and a plain-text conversion record. Both name the response they come from in
WARC-Refers-To. Everything is column expressions: one pass over the pages, no shuffle.

Pages may bring their own headers (a map) and date; without them the headers are those of an HTML
page of that length, and the date is the parameter's. Columns of the input that are named like a
record's own are left out of the derivatives.

Null html is an empty payload with an empty conversion; a null url stays null in the records, and
its response id is made from the page id alone. Repeated pages give repeated records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a derivative beside the keys.
RECORD = ("warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_payload_digest", "source_headers", "block", "_text", "r")
#: What is not text: scripts, styles, comments, any other tag.
MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
#: Entities that are decoded, &amp; last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def plain_text(html: Column) -> Column:
    """Text of a page: markup becomes a blank, entities are decoded, white space runs become one blank."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), MARKUP, " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made of the md5 of the parts."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", headers_column: str | None = None, date_column: str | None = None) -> DataFrame:
    """Response records of raw pages: record_id, target_uri, date, http_headers (map), payload and payload_digest.

    headers_column: a map of the headers that came with the page; date_column: when (a timestamp). Null ones get the default.
    """
    payload = F.coalesce("html", F.lit(""))
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length(payload).cast("string"))
    if headers_column:
        headers = F.coalesce(F.col(headers_column), headers)
    when = F.coalesce(F.date_format(date_column, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(date)) if date_column else F.lit(date)
    return pages.select("page_id", record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), when.alias("date"), headers.alias("http_headers"), payload.alias("payload"), digest(payload).alias("payload_digest"))


def derivatives(response: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response, with headers as a map and the block as text.

    Other columns of the input (its key) are kept in front.
    """
    own = ["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"]
    keys = [c for c in response.columns if c not in own and c not in RECORD]
    text = plain_text(F.col("payload"))
    lines = F.concat_ws("\r\n", F.transform(F.map_entries("http_headers"), lambda e: F.concat(F.lit("source-header: "), e["key"], F.lit("="), e["value"])))
    facts = F.concat(lines, F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\ntext-digest: "), digest(F.col("_text")), F.lit("\r\n"))
    made = response.withColumn("_text", text).select(
        *keys, "record_id", "target_uri", "date", "http_headers", "payload_digest",
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), facts.alias("block")),
            F.struct(F.lit("conversion").alias("type"), F.lit("text/plain").alias("content_type"), F.col("_text").alias("block")),
        )).alias("r"),
    )
    return made.select(
        *keys, F.col("r.type").alias("warc_type"), record_id(F.col("r.type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("r.content_type").alias("content_type"),
        F.octet_length("r.block").cast("bigint").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), F.col("payload_digest").alias("source_payload_digest"), F.col("http_headers").alias("source_headers"), F.col("r.block").alias("block"),
    )


def warc_text(record: DataFrame) -> DataFrame:
    """The records of derivatives as WARC/1.1 text, in column warc."""
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))).otherwise("")

    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length")),
    )
    return record.withColumn("warc", F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")))


def derivative_report(pages: DataFrame) -> DataFrame:
    """Both records of each page, the block as its length and digest."""
    return derivatives(responses(pages)).select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_payload_digest", F.element_at("source_headers", "Content-Length").alias("source_length"))


def _uuid_sql(expression: str) -> str:
    return f"'<urn:uuid:' || substr({expression}, 1, 8) || '-' || substr({expression}, 9, 4) || '-' || substr({expression}, 13, 4) || '-' || substr({expression}, 17, 4) || '-' || substr({expression}, 21, 12) || '>'"


def _report_sql() -> str:
    text = f"regexp_replace(coalesce(html, ''), '{MARKUP}', ' ', 'g')"
    for entity, char in ENTITIES:
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    text = rf"trim(regexp_replace({text}, '[ \t\r\n\f]+', ' ', 'g'), ' ')"
    length = "CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR)"
    crlf = "chr(13) || chr(10)"
    return f"""
WITH source AS (
  SELECT page_id, url AS target_uri, {text} AS txt, {length} AS source_length, 'sha256:' || sha256(coalesce(html, '')) AS source_payload_digest,
         md5('response|' || CAST(page_id AS VARCHAR) || coalesce('|' || url, '')) AS h
  FROM pages
), response AS (
  SELECT *, {_uuid_sql("h")} AS refers_to FROM source
), record AS (
  SELECT page_id, target_uri, refers_to, source_length, source_payload_digest, 'conversion' AS warc_type, 'text/plain' AS content_type, txt AS block FROM response
  UNION ALL
  SELECT page_id, target_uri, refers_to, source_length, source_payload_digest, 'metadata', 'application/warc-fields',
         'source-header: Content-Type=text/html; charset=utf-8' || {crlf} || 'source-header: Content-Length=' || source_length || {crlf}
         || 'source-payload-digest: ' || source_payload_digest || {crlf} || 'text-digest: sha256:' || sha256(txt) || {crlf}
  FROM response
), named AS (
  SELECT *, md5(warc_type || '|' || refers_to) AS g FROM record
)
SELECT page_id, warc_type, {_uuid_sql("g")} AS record_id, refers_to, target_uri, content_type,
       CAST(octet_length(encode(block)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_payload_digest, source_length
FROM named"""


REPORT_SQL = _report_sql()

"""Quality gates: authority of sources, interval coverage, extraction and retrieval figures, outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions.routing import route
from attesta.operators.integrity import chunk_invariants


def authoritative(url: Column, domains: list[str]) -> Column:
    """https and a host that is one of the domains or below one."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))
    return url.startswith("https://") & reduce(Column.__or__, [(host == d) | host.endswith("." + d) for d in domains])


def interval_coverage(spans: DataFrame, key: str, start: str, end: str, total: str) -> DataFrame:
    """key and covered: the length of the union of intervals, each clipped to 0..total. The running maximum of ends parts what is new from what overlaps."""
    s, e = F.greatest(F.col(start), F.lit(0)), F.least(F.col(end), F.col(total))
    clipped = spans.select(key, s.alias("_s"), e.alias("_e")).where("_e > _s")
    reached = F.max("_e").over(Window.partitionBy(key).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1))
    new = clipped.withColumn("_r", reached).groupBy(key).agg(F.sum(F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col("_s"), F.coalesce("_r", "_s")))).alias("covered"))
    return spans.select(key).distinct().join(new, key, "left").select(key, F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"))


def retrieval_figures(retrieved: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: hits, retrieved, gold, recall and precision (2 places) over distinct keys of questions that have gold."""
    r = retrieved.select(*keys).distinct().join(gold.select(keys[0]).distinct(), keys[0], "left_semi")
    g = gold.select(*keys).distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(r.join(g, keys, "left_semi"), "hits").crossJoin(n(r, "retrieved")).crossJoin(n(g, "gold"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 2)).otherwise(0.0)
    return one.withColumn("recall", share("hits", "gold")).withColumn("precision", share("hits", "retrieved"))


def golden_figures(retrieved: DataFrame, gold: DataFrame, question: str, item: str) -> DataFrame:
    """One row: the figures of retrieval_figures over questions that want an answer, how many of those to be abstained from got no rows, and leaks.

    retrieved: question, item and allowed (whether the row is of an asked jurisdiction); gold: question, item and abstain.
    """
    wanted = gold.groupBy(question).agg(F.bool_or("abstain").alias("abstain"))
    rows = retrieved.join(wanted, question)
    figures = retrieval_figures(rows.where("NOT abstain"), gold.join(wanted.where("NOT abstain").select(question), question), [question, item])
    kept = wanted.where("abstain").join(retrieved.select(question).distinct().withColumn("_got", F.lit(True)), question, "left").agg(F.count("*").alias("n"), F.count_if(F.col("_got").isNull()).alias("ok"))
    leaks = rows.agg(F.count_if(~F.col("allowed")).alias("leaks"))
    return figures.crossJoin(kept.select(F.when(F.col("n") > 0, F.round(F.col("ok") / F.col("n"), 2)).otherwise(0.0).alias("abstention_accuracy"))).crossJoin(leaks)


def routing_figures(cases: DataFrame, question: str) -> DataFrame:
    """kind (scope or phrasing), name, n and accuracy of the router: a case passes if it is routed out of scope just where its scope is out_of_domain.

    By scope over all cases, by phrasing over the answerable ones.
    """
    passed = (route(F.col(question))["intent"] != "out_of_scope") == (F.col("scope") != "out_of_domain")
    judged = cases.withColumn("_p", passed.cast("double"))
    part = lambda df, kind: df.groupBy(F.col(kind).alias("name")).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.avg("_p"), 6).alias("accuracy"))
    return part(judged, "scope").unionByName(part(judged.where("scope = 'answerable'"), "phrasing"))


def extraction_quality(chunks: DataFrame, documents: DataFrame, source: str, least: float = 0.70) -> DataFrame:
    """source, covered, coverage (3 places), invalid_offsets, missing_boxes and issues (array) of each source with chunks.

    chunks: source, text, sha256, char_start, char_end, has_box; documents: source, full_text. Overlaps count once.
    """
    checked = chunk_invariants(chunks, documents, source)
    total = documents.select(source, F.length("full_text").alias("_total"))
    covered = interval_coverage(chunks.join(total, source), source, "char_start", "char_end", "_total")
    counts = checked.groupBy(source).agg(F.count_if(~F.col("offset_valid")).alias("invalid_offsets"), F.count_if(~F.col("has_box")).alias("missing_boxes"))
    joined = counts.join(covered, source).join(total, source).withColumn("_r", F.when(F.col("_total") > 0, F.col("covered") / F.col("_total")).otherwise(0.0))
    issues = F.array(F.when(F.col("_r") < least, "low_coverage"), F.when(F.col("invalid_offsets") > 0, "invalid_offsets"), F.when(F.col("missing_boxes") > 0, "missing_boxes"))
    return joined.select(source, "covered", F.round("_r", 3).alias("coverage"), "invalid_offsets", "missing_boxes", F.filter(issues, lambda x: x.isNotNull()).alias("issues"))


def needs_ocr_review(text: Column, raw: Column, density: Column, floor: float = 3.0, short: int = 100) -> Column:
    """Whether a page is to be read again: no text after navigation marks are taken out, and none in the raw page either; or little text and thin."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<<\s*previous\b.*?\bnext\s*>>", ""))
    return F.when(body == "", F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")) == "").otherwise((density < floor) & (F.length(body) < short))


def page_density(text: Column, area: Column) -> Column:
    """Characters for each 1,000 units of the page's area; 0 for a page without area."""
    return F.when(area > 0, F.length(text) * 1000.0 / area).otherwise(0.0)


def topic_status(sources: str, indexed: str) -> Column:
    """indexed, partial or not_indexed, by how many of a topic's sources are in the corpus; special for a topic without sources."""
    have = F.size(F.array_intersect(sources, indexed))
    return F.when(F.size(sources) == 0, "special").when(have == F.size(sources), "indexed").when(have > 0, "partial").otherwise("not_indexed")


def outcome(advice: str = "advice", outside: str = "outside", evidence: str = "evidence", generated: str = "generated", abstain: str = "abstain", late: str | None = None, unverified: str | None = None) -> Column:
    """answer, or the first reason for a refusal. late and unverified name columns for a deadline that passed and for claims that all failed their checks; without them neither is a reason."""
    out = F.when(F.col(advice), "legal_advice").when(F.col(outside), "out_of_scope").when(~F.col(evidence), "no_evidence")
    if late:
        out = out.when(F.col(late), "deadline")
    out = out.when(~F.col(generated), "generation_unavailable")
    if unverified:
        out = out.when(F.col(unverified), "verification_failed")
    return out.when(F.col(abstain), "low_confidence").otherwise("answer")

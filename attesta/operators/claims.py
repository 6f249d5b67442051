"""Claims and their evidence: packs, citations, checks and the assembled answer.

Shapes: a pack has query_id, number (E1 is 1), evidence_id, jurisdiction, doc_id, corpus_version, section_key,
section_path (array), citation_label and text. A claim has query_id, claim_no, statement and evidence_ids
(array of `E1`, `E2`, ...). A claim's evidence is small (bounded by the pack of one query), so it is gathered in arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx


def evidence_pack(ranked: DataFrame, sections: DataFrame, documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Ranked chunks as numbered, citable spans; chunks whose section or document is missing are dropped, an artifact is optional.

    ranked: query_id, rank, chunk_id, section_id, char_start, char_end, page, text; sections: section_id, document_id, section_key, section_path, heading,
    page_start, page_end; documents: document_id, doc_id, title, jurisdiction, source_url; artifacts: doc_id, artifact_url.
    A page of 0 counts as unknown, as null does; pages fall back from the chunk to its section, and to 0.
    """
    page = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit(0)) for n in names], F.lit(0))
    joined = ranked.join(sections, "section_id").join(documents, "document_id").join(artifacts, "doc_id", "left")
    return joined.select(
        "query_id", F.col("rank").alias("number"), tx.evidence_id(F.col("chunk_id").cast("string"), F.col("char_start"), F.col("char_end")).alias("evidence_id"), "chunk_id", "doc_id", "jurisdiction",
        tx.citation_label(F.col("title"), F.col("section_key"), F.col("heading")).alias("citation_label"), "section_key", "section_path", page("page", "page_start").alias("page"), page("page", "page_end").alias("page_end"),
        "char_start", "char_end", "text", F.coalesce("artifact_url", "source_url").alias("source_url"),
    )


def prompt_block(number: Column, label: Column, jurisdiction: Column, path: Column, text: Column) -> Column:
    return F.concat(F.lit("[E"), number.cast("string"), F.lit("] "), label, F.lit(" ["), jurisdiction, F.lit("]\n"), F.array_join(path, " > "), F.lit("\n"), text)


def prompts(pack: DataFrame) -> DataFrame:
    """query_id and prompt: the blocks of a pack in the order of their numbers, with an empty line between."""
    block = prompt_block(F.col("number"), F.col("citation_label"), F.col("jurisdiction"), F.col("section_path"), F.col("text"))
    rows = pack.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", block.alias("block")))).alias("b"))
    return rows.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("prompt"))


def resolve_claims(claims: DataFrame, pack: DataFrame) -> DataFrame:
    """claims with resolved (array of evidence_id, in the claim's order), jurisdiction and dropped.

    dropped says why: unknown_reference if any reference isn't in the pack of the query (or names nothing), mixed_jurisdictions
    if the evidence is of several; null for claims that stay. References are read as E and a number, in any case.
    """
    refs = claims.select("query_id", "claim_no", F.posexplode("evidence_ids").alias("at", "ref"))
    refs = refs.withColumn("number", F.regexp_extract(F.trim("ref"), r"(?i)^E(\d{1,9})$", 1).try_cast("int"))
    known = pack.select("query_id", "number", F.col("evidence_id").alias("_e"), F.col("jurisdiction").alias("_j"))
    met = refs.join(known, ["query_id", "number"], "left").groupBy("query_id", "claim_no").agg(
        F.bool_and(F.col("_e").isNotNull()).alias("found"), F.array_sort(F.collect_list(F.struct("at", "_e"))).alias("e"), F.collect_set("_j").alias("js"))
    found = F.coalesce("found", F.lit(False))
    reason = F.when(~found, "unknown_reference").when(F.size("js") > 1, "mixed_jurisdictions")
    out = claims.join(met, ["query_id", "claim_no"], "left").withColumn("dropped", reason)
    kept = F.col("dropped").isNull()
    return out.withColumn("resolved", F.when(kept, F.transform("e", lambda x: x["_e"]))).withColumn("jurisdiction", F.when(kept, F.element_at("js", 1))).drop("found", "e", "js")


def ancestor_pairs(pack: DataFrame) -> DataFrame:
    """query_id, evidence_id and parent: spans of the same document, jurisdiction and version whose path is the beginning of the span's own.

    An equi-join on the pack, the document and each proper beginning of the path; no pair without a common key is ever made.
    """
    keys = ["query_id", "doc_id", "jurisdiction", "corpus_version"]
    children = pack.where(F.size("section_path") > 1).select(*keys, "evidence_id", "section_key", F.explode(F.transform(F.sequence(F.lit(1), F.size("section_path") - 1), lambda i: F.slice("section_path", F.lit(1), i))).alias("_path"))
    parents = pack.where(F.size("section_path") > 0).select(*keys, F.col("section_path").alias("_path"), F.col("evidence_id").alias("parent"), F.col("section_key").alias("_parent_key"))
    return children.join(parents, [*keys, "_path"]).where("section_key <> _parent_key").select("query_id", "evidence_id", "parent", F.size("_path").alias("depth"))


def with_parents(claims: DataFrame, pack: DataFrame) -> DataFrame:
    """Resolved claims with cited: each span's ancestors, nearest the root first, before the span itself; a span that was met before isn't repeated."""
    up = ancestor_pairs(pack).groupBy("query_id", "evidence_id").agg(F.array_sort(F.collect_set(F.struct("depth", "parent"))).alias("up"))
    spans = claims.where("dropped IS NULL").select("query_id", "claim_no", F.posexplode("resolved").alias("at", "evidence_id")).join(up, ["query_id", "evidence_id"], "left")
    own = F.concat(F.coalesce(F.transform("up", lambda x: x["parent"]), F.array().cast("array<string>")), F.array("evidence_id"))
    rows = spans.groupBy("query_id", "claim_no").agg(F.array_sort(F.collect_list(F.struct("at", own.alias("ids")))).alias("s"))
    return claims.join(rows.select("query_id", "claim_no", F.array_distinct(F.flatten(F.transform("s", lambda x: x["ids"]))).alias("cited")), ["query_id", "claim_no"])


def verify_claims(claims: DataFrame, pack: DataFrame, entailment: str = "entailment") -> DataFrame:
    """Resolved claims (with cited, see with_parents) and their premise, checks and verdict.

    The premise is the cited spans' paths and texts in order; years and numbers of cited titles that the claim names, and section
    references that the cited keys prove, are allowed too.
    """
    spans = claims.select("query_id", "claim_no", F.posexplode("cited").alias("at", "evidence_id")).join(pack.select("query_id", "evidence_id", "section_key", "section_path", "citation_label", "text").dropDuplicates(["query_id", "evidence_id"]), ["query_id", "evidence_id"])
    shown = F.concat(F.array_join("section_path", " > "), F.lit("\n"), F.col("text"))
    rows = spans.groupBy("query_id", "claim_no").agg(
        F.array_sort(F.collect_list(F.struct("at", shown.alias("t"), F.col("citation_label").alias("l")))).alias("s"), F.array_distinct(F.flatten(F.collect_list(tx.cited_locators(F.col("section_key"))))).alias("located"))
    premise = F.array_join(F.transform("s", lambda x: x["t"]), "\n\n")
    joined = claims.join(rows, ["query_id", "claim_no"]).withColumn("premise", premise)
    titles = tx.named_titles(F.col("statement"), F.transform("s", lambda x: x["l"]))
    return joined.withColumn("verdict", tx.claim_verdict(F.col(entailment), F.col("statement"), F.col("premise"), titles, F.col("located"))).drop("s", "located")


KEPT = ("verified", "partial")


def verification_outcome(verified: DataFrame, entailment: str = "entailment") -> DataFrame:
    """query_id, kept, dropped, mean_entailment (of the kept ones, 0 without any), drop_reasons (map), verified_ratio and review (any partial claim)."""
    kept = F.col("verdict").isin(*KEPT)
    reasons = verified.where(~kept).groupBy("query_id", "verdict").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("drop_reasons"))
    figures = verified.groupBy("query_id").agg(
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.coalesce(F.round(F.avg(F.when(kept, F.col(entailment))), 6), F.lit(0.0)).alias("mean_entailment"),
        F.round(F.count_if(F.col("verdict") == "verified") / F.count("*"), 6).alias("verified_ratio"), F.bool_or(F.col("verdict") == "partial").alias("review"))
    return figures.join(reasons, "query_id", "left").withColumn("drop_reasons", F.coalesce("drop_reasons", F.create_map().cast("map<string,bigint>")))


def cited_only(pack: DataFrame, verified: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """Spans of the pack that a kept claim cites or that are among the nearest sources (query_id, evidence_id)."""
    named = verified.where(F.col("verdict").isin(*KEPT)).select("query_id", F.explode("cited").alias("evidence_id"))
    every = named if nearest is None else named.unionByName(nearest.select("query_id", "evidence_id"))
    return pack.join(every.distinct(), ["query_id", "evidence_id"], "left_semi")


def nearest_sources(pack: DataFrame, n: int = 3) -> DataFrame:
    return pack.where(F.col("number") <= n)


def answer_sections(verified: DataFrame, pack: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, jurisdiction, position, claims (statements in order) and gaps of the sections of an answer.

    asked: query_id, jurisdictions (array), gaps (array). Kept claims stand under the jurisdiction of their first evidence; every asked
    jurisdiction has a section, then others that claims bring; gaps stand in the first section only.
    """
    first = verified.where(F.col("verdict").isin(*KEPT)).select("query_id", "claim_no", "statement", F.element_at("cited", 1).alias("evidence_id"))
    of = pack.select("query_id", "evidence_id", "jurisdiction").dropDuplicates(["query_id", "evidence_id"])
    claims = first.join(of, ["query_id", "evidence_id"]).groupBy("query_id", "jurisdiction").agg(F.array_sort(F.collect_list(F.struct("claim_no", "statement"))).alias("c"))
    sections = asked.select("query_id", F.posexplode("jurisdictions").alias("position", "jurisdiction"))
    both = sections.join(claims, ["query_id", "jurisdiction"], "full_outer").join(asked.select("query_id", "gaps"), "query_id", "left")
    none = F.array().cast("array<string>")
    return both.select("query_id", "jurisdiction", "position", F.coalesce(F.transform("c", lambda x: x["statement"]), none).alias("claims"), F.when(F.col("position") == 0, F.coalesce("gaps", none)).otherwise(none).alias("gaps"))


def answers(verified: DataFrame, pack: DataFrame, asked: DataFrame, terms: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """query_id, sections (array, see answer_sections, asked jurisdictions first), evidence (map of evidence_id to its span, of all that kept claims cite) and glossary.

    asked: query_id, lang, jurisdictions, gaps. The glossary holds the locked terms (term, glosses by language) that kept claims use and the language glosses; none
    for English. All that is gathered of a query is bounded by its pack and claims.
    """
    parts = answer_sections(verified, pack, asked)
    last = F.coalesce("position", F.lit(2**31 - 1))
    sections = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(last.alias("position"), "jurisdiction", "claims", "gaps"))).alias("s"))
    span = F.struct("number", "citation_label", "jurisdiction", "section_key", "section_path", "text")
    spans = cited_only(pack, verified).groupBy("query_id", "evidence_id").agg(F.min_by(span, "number").alias("span"))
    evidence = spans.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("evidence_id", "span")))).alias("evidence"))
    kept = verified.where(F.col("verdict").isin(*KEPT)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "statement"))).alias("c"))
    said = F.array_join(F.transform("c", lambda x: x["statement"]), " ")
    none = F.array().cast("array<struct<term:string,gloss:string>>")
    glossed = [F.when(F.col("lang") == lang, tx.glossary(said, terms, lang)) for lang in sorted({k for _, g in terms for k in g})]
    joined = asked.select("query_id", "lang").join(sections, "query_id", "left").join(evidence, "query_id", "left").join(kept, "query_id", "left")
    return joined.select("query_id", F.transform("s", lambda x: x.dropFields("position")).alias("sections"), F.coalesce("evidence", F.create_map().cast(evidence.schema["evidence"].dataType)).alias("evidence"), F.coalesce(*glossed, none).alias("glossary"))

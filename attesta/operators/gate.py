"""The retrieval gate: version, jurisdiction and validity, before anything is ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Requests that are broadcast at most, and parts that a jurisdiction's chunks are dealt to beyond that.
BROADCAST_ROWS, SALTS = 200_000, 64


def valid_on(day: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity: start <= day < end, an absent end is open."""
    return (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day))


def gate(chunks: DataFrame, version: str, jurisdictions: list[str], as_of: str, doc_types: list[str] | None = None) -> DataFrame:
    """Chunks of one version that hold in the jurisdictions on a day."""
    kept = chunks.where((F.col("version") == version) & F.col("jurisdiction").isin(jurisdictions) & valid_on(F.lit(as_of).cast("date")))
    return kept if doc_types is None else kept.where(F.col("doc_type").isin(doc_types))


def gate_requests(requests: DataFrame, chunks: DataFrame, version: str = "live") -> DataFrame:
    """Each request (jurisdiction, as_of) with every chunk it may see: an equi-join by jurisdiction with the validity as residual.

    There are few jurisdictions, so beyond a broadcast of the requests both sides are salted: a chunk goes to one of SALTS parts of its jurisdiction, a request to all.
    """
    held = chunks.where(F.col("version") == version)
    if requests.count() <= BROADCAST_ROWS:
        return held.join(F.broadcast(requests), "jurisdiction").where(valid_on(F.col("as_of")))
    dealt = requests.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return held.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")).join(dealt, ["jurisdiction", "_salt"]).where(valid_on(F.col("as_of"))).drop("_salt")


def regate(candidates: DataFrame, gated: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates from elsewhere, only where the gate lets them through."""
    return candidates.join(gated.select(*keys).distinct(), keys, "left_semi")


def missing_instruments(requested: str, available: str) -> Column:
    """Whether a request names an instrument that the corpus lacks."""
    return F.size(F.array_except(requested, available)) > 0


def default_day(as_of: Column, today: str) -> Column:
    """The day of a request, or an injected today if it names none."""
    return F.coalesce(as_of, F.lit(today).cast("date"))


def listed(documents: DataFrame, jurisdiction: str | None = None, doc_type: str | None = None) -> DataFrame:
    """Documents by optional filters; BOTH and null take any jurisdiction."""
    kept = documents if jurisdiction in (None, "BOTH") else documents.where(F.col("jurisdiction") == jurisdiction)
    return kept if doc_type is None else kept.where(F.col("doc_type") == doc_type)


def artifact_of(document_versions: DataFrame, documents: DataFrame, versions: DataFrame, label: str) -> DataFrame:
    """doc_key, path, sha256 and source_url of each document's artifact in the version with a label; the least path of several.

    document_versions: document_id, version_id, path, sha256, source_url; documents: document_id, doc_key; versions: version_id, label.
    """
    named = document_versions.join(versions.where(F.col("label") == label).select("version_id"), "version_id").join(documents.select("document_id", "doc_key"), "document_id")
    first = named.groupBy("doc_key").agg(F.min(F.struct("path", "sha256", "source_url")).alias("a"))
    return first.select("doc_key", "a.path", "a.sha256", "a.source_url")

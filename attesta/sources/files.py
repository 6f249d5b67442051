"""Sources and sinks: manifests, list-valued CSV, JSON lines, links of pages, versioned snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attesta.operators.integrity import EMPTY_ROOT, merkle_roots
from attesta.operators.stages import observed_write
from attesta.sources import commits

MANIFEST = "id string, title string, jurisdiction string, doc_type string, issuer string, tier string, language string, url string, sha256 string, in_force_from date, in_force_to date, download_strategy string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON-lines manifest, with defaults for tier, language and strategy."""
    return spark.read.schema(MANIFEST).json(path).fillna({"tier": "A", "language": "en", "download_strategy": "pdf"})


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; a line that doesn't parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that don't parse, in column line."""
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).where(F.trim("value") != "").select(read["_bad"].alias("line")).where("line IS NOT NULL")


def yaml_rows(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of a list in a YAML file (a small configuration file, which the driver reads); fields that the schema doesn't name are an error, absent ones null."""
    import yaml

    names = StructType.fromDDL(schema).names
    rows = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])[field]
    extra = {k for r in rows for k in r} - set(names)
    if extra:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    as_text = lambda v: v.isoformat() if hasattr(v, "isoformat") else v
    lines = [(json.dumps({k: as_text(v) for k, v in r.items()}),) for r in rows]
    return spark.createDataFrame(lines, "line string").select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def yaml_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a YAML manifest (a list named sources), with the defaults of manifest."""
    return yaml_rows(spark, path, "sources", MANIFEST).fillna({"tier": "A", "language": "en", "download_strategy": "pdf"})


def single_candidate(links: DataFrame, pages: DataFrame, key: str, host: str, folder: str) -> DataFrame:
    """key, url and error: the one PDF that a page links to. pages: key, url, title; links: key, place, href, text.

    Candidates are .pdf links on the host whose path holds the folder; relative links are led by the page's url. One whose text equals the title
    (in any case) wins if it is the only such one; else the only candidate; else the error is ambiguous or none.
    """
    base = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*)", 1)
    full = F.when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.regexp_extract("url", r"^([a-zA-Z]+:)", 1), "href")).when(F.col("href").startswith("/"), F.concat(base, "href")).otherwise(F.concat(F.regexp_replace("url", r"[^/]*$", ""), "href"))
    led = links.join(pages.select(key, "url", "title"), key).withColumn("full", full)
    path = F.lower(F.regexp_extract("full", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    named = led.where((F.lower(F.regexp_extract("full", r"^[a-zA-Z]+://([^/?#:]*)", 1)) == host) & path.endswith(".pdf") & F.contains(path, F.lit(folder.lower())))
    last = named.groupBy(key, "full").agg(F.max_by("text", "place").alias("text"), F.max("title").alias("title"))  # of links to one file the last on the page counts
    same = F.lower("text") == F.lower("title")
    counts = last.groupBy(key).agg(F.count("*").alias("n"), F.count_if(same).alias("exact"), F.max(F.when(same, F.col("full"))).alias("by_title"), F.max("full").alias("only"))
    chosen = F.when(F.col("exact") == 1, F.col("by_title")).when(F.col("n") == 1, F.col("only"))
    return pages.select(key).join(counts.withColumn("url", chosen), key, "left").select(key, "url", F.when(F.col("url").isNotNull(), None).when(F.coalesce("n", F.lit(0)) == 0, "none").otherwise("ambiguous").alias("error"))


def split_list(text: Column, separator: str = ";") -> Column:
    """Trimmed, nonempty parts of a list in a cell."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def list_csv(spark: SparkSession, path: str, schema: str, lists: list[str]) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumns({c: split_list(F.col(c)) for c in lists})


def is_pdf(content: Column) -> Column:
    """Whether the magic of a PDF is in the first 1024 bytes."""
    return F.contains(F.hex(F.substring(content, 1, 1024)), F.lit("255044462D"))


def fetched(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """path, sha256 and verdict (ok, not_pdf, changed) of binary files against pinned digests; a file without a pin is ok and gets pinned."""
    f = files.select("path", F.sha2("content", 256).alias("sha256"), is_pdf(F.col("content")).alias("pdf"))
    p = pinned.select("path", F.col("sha256").alias("_pin"))
    return f.join(p, "path", "left").select("path", "sha256", F.when(~F.col("pdf"), "not_pdf").when(F.col("_pin") != F.col("sha256"), "changed").otherwise("ok").alias("verdict"))


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, place (from 0 on), href and text of the links of a page, in quotes."""
    shape = r"""(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(shape), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(shape), F.lit(2)).alias("text"))
    return pages.select(key, F.posexplode(pairs).alias("place", "a")).select(key, "place", F.col("a.href").alias("href"), F.trim(F.regexp_replace("a.text", r"<[^>]*>", "")).alias("text"))


def write_version(chunks: DataFrame, path: str, version: str) -> None:
    """One immutable folder for each version and source; a version that is there is never written again."""
    chunks.withColumn("version", F.lit(version)).write.mode("errorifexists").partitionBy("source").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: str, expected: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """A version's rows; with expected digests (chunk_id, sha256), rows whose text changed raise an error when read.

    With a root, the Merkle root over the texts' hashes in the order of chunk_id is built first, and a different one is an error.
    """
    df = spark.read.parquet(f"{path}/version={version}")
    if root is not None:
        leaves = df.select(F.lit(version).alias("tree"), "chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("leaf"))
        found = merkle_roots(leaves, "tree", "chunk_id", "leaf").first()
        if (found["root"] if found else EMPTY_ROOT) != root:
            raise ValueError(f"version {version} does not have the root {root}")
    if expected is None:
        return df
    checked = df.join(expected.select("chunk_id", F.col("sha256").alias("_d")), "chunk_id")
    return checked.where(F.when(F.sha2(F.col("text").cast("binary"), 256) == F.col("_d"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("changed: "), F.col("chunk_id"))).cast("boolean"))).drop("_d")


#: The tables of a source in a version.
TABLES = ("sections", "chunks", "edges", "document_versions")


def write_source(tables: dict[str, DataFrame], path: str, version: str, source: str, since: int | None = None) -> str:
    """Write a source's tables into a folder of their own, then commit it: a source counts only once all its tables are there. Returns the folder.

    A run that dies leaves a folder that no commit names, which nobody reads. since: the newest commit that the tables were made from (by default the
    newest one now); if another writer commits the same source after it, this one raises commits.Conflict.
    """
    if set(tables) != set(TABLES):
        raise ValueError(f"a source has the tables {TABLES}")
    spark = tables["chunks"].sparkSession
    since = commits.newest(spark, path) if since is None else since
    folder = f"{path}/version={version}/source={source}/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    commits.commit(spark, path, {"kind": "source", "version": version, "source": source, "folder": folder}, since)
    return folder


def read_source_tables(spark: SparkSession, path: str, version: str, name: str) -> DataFrame:
    """One table of a version, over all its committed sources."""
    folders = [r["folder"] for r in commits.committed(spark, path).where(F.col("version") == version).select("folder").collect()]  # a commit a source: a short list of paths
    return spark.read.parquet(*[f"{f}/{name}" for f in folders])


def pending_sources(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources of a manifest (id, sha256) that aren't committed yet, or whose pinned digest changed since. done: id, sha256."""
    return sources.join(done.select("id", F.col("sha256").alias("_d")), "id", "left").where(F.col("_d").isNull() | ~F.col("_d").eqNullSafe(F.col("sha256"))).drop("_d")


def export_version(tables: dict[str, DataFrame], version: str) -> dict[str, DataFrame]:
    """The tables of one version: versions, sections, chunks, edges and document_versions by their version, documents by the sections that name them."""
    own = {name: df.where(F.col("version") == version) for name, df in tables.items() if name != "documents"}
    return own | {"documents": tables["documents"].join(own["sections"].select("document_id").distinct(), "document_id", "left_semi")}


def _fingerprint(columns: list[str]) -> Column:
    """A whole number for each row, from its columns' hash; a table's sum of them doesn't depend on the order of its rows, and repeats count."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.sha2(text, 256), 1, 9), 16, 10).cast("bigint")


def save_snapshot(tables: dict[str, DataFrame], version: str, path: str) -> DataFrame:
    """Export the six tables of a version (export_version) as one operation; returns its list: table, rows and digest.

    Rows and digests are observed while the tables are written. The list is written last, so a snapshot without one isn't whole.
    """
    spark, found = tables["documents"].sparkSession, []
    for name, df in sorted(export_version(tables, version).items()):
        seen = observed_write(df, f"{path}/{name}", {"digest": F.sum(_fingerprint(df.columns))})
        found.append((name, seen["rows"], seen["digest"], df.schema.json()))
    spark.createDataFrame(found, "table string, rows bigint, digest bigint, schema string").coalesce(1).write.json(f"{path}/list")
    return spark.createDataFrame([f[:3] for f in found], "table string, rows bigint, digest bigint")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, each read once to check its rows and digest against the list; a difference is an error."""
    out = {}
    for kept in spark.read.schema("table string, rows bigint, digest bigint, schema string").json(f"{path}/list").collect():  # six rows
        df = spark.read.schema(StructType.fromJson(json.loads(kept["schema"]))).parquet(f"{path}/{kept['table']}")
        now = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_fingerprint(df.columns)), F.lit(0)).alias("digest")).first()
        if (now["rows"], now["digest"]) != (kept["rows"], kept["digest"]):
            raise ValueError(f"the snapshot's {kept['table']} is not what was written")
        out[kept["table"]] = df
    return out


def ingest_report(sections: DataFrame, edges: DataFrame, warnings: DataFrame, sources: DataFrame) -> DataFrame:
    """source, sections, edges, unlocated (chunks without boxes), orphans and warnings of every source, 0 where it has none.

    sections: source, key, has_box; edges: source, dst, kind; warnings: source.
    """
    targets = edges.where("kind = 'proviso_of'").select("source", F.col("dst").alias("key")).distinct().withColumn("_met", F.lit(True))
    part = F.col("key").rlike("-(proviso|explanation)$")
    s = sections.join(targets, ["source", "key"], "left").groupBy("source").agg(F.count("*").alias("sections"), F.count_if(~F.col("has_box")).alias("unlocated"), F.count_if(part & F.col("_met").isNull()).alias("orphans"))
    e, w = edges.groupBy("source").agg(F.count("*").alias("edges")), warnings.groupBy("source").agg(F.count("*").alias("warnings"))
    names = ["sections", "edges", "unlocated", "orphans", "warnings"]
    return sources.select("source").distinct().join(s, "source", "left").join(e, "source", "left").join(w, "source", "left").select("source", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A small report as one JSON-lines file and one Markdown table. Reports hold a row a source or a figure, so one task writes them."""
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{' --- |' * len(rows.columns)}"
    spark = rows.sparkSession
    spark.createDataFrame([(0, head)], "o int, value string").unionByName(rows.select(F.lit(1).alias("o"), cells.alias("value"))).coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(f"{path}/markdown")


def stage_events(stages: DataFrame, request: str) -> DataFrame:
    """request, seq, event and data: a stage frame for each stage in order, then result, or error for a stage that failed and nothing after it, then done.

    stages: request, position, stage, status (ok, skipped, failed) and payload.
    """
    failed = stages.where("status = 'failed'").groupBy(request).agg(F.min("position").alias("_stop"))
    kept = stages.join(failed, request, "left").where("_stop IS NULL OR position <= _stop")
    frames = kept.select(request, F.col("position").alias("seq"), F.when(F.col("status") == "failed", "error").otherwise("stage").alias("event"), F.to_json(F.struct("stage", "status")).alias("data"))
    last = kept.groupBy(request).agg(F.max("position").alias("p"), F.max_by("payload", "position").alias("payload"), F.max(F.col("_stop")).alias("_stop"))
    results = last.where("_stop IS NULL").select(request, (F.col("p") + 1).alias("seq"), F.lit("result").alias("event"), F.col("payload").alias("data"))
    return frames.unionByName(results).unionByName(last.select(request, (F.col("p") + 2).alias("seq"), F.lit("done").alias("event"), F.lit("{}").alias("data")))


def stage_timings(stages: DataFrame, request: str) -> DataFrame:
    """request, total (ms of the stages that ran), skipped and slowest. stages: request, stage, status, ms."""
    ran = F.col("status") != "skipped"
    return stages.groupBy(request).agg(F.coalesce(F.sum(F.when(ran, F.col("ms"))), F.lit(0)).alias("total"), F.count_if(~ran).alias("skipped"), F.max_by("stage", F.struct(F.when(ran, F.col("ms")), "stage")).alias("slowest"))


def next_check(checked_at: Column, days: int = 7) -> Column:
    return checked_at + F.make_dt_interval(F.lit(days))


def due(next_check_at: Column, now: str) -> Column:
    """Whether a source is to be checked: its time has come, or is unknown."""
    return F.coalesce(next_check_at <= F.lit(now).cast("timestamp"), F.lit(True))


def update_candidate(checks: DataFrame) -> bool:
    """Whether checks (status) make a candidate manifest: something changed and no check failed."""
    r = checks.agg(F.count_if(F.col("status").isin("changed", "added")).alias("c"), F.count_if(F.col("status") == "check_failed").alias("f")).first()
    return r["c"] > 0 and r["f"] == 0


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables holds, with side (left or right); repeats count. None if the tables are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))

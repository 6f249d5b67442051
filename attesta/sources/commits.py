"""A log of numbered commits beside versioned tables: which sources a version holds, and which version is live.

Commit n is the file commits/n.json, put there whole and only if no other writer put one there before. A writer that loses the place
looks at what came in between: it takes the next place, or gives up if that touches what its own commit rests on. So two writers of one source, or two
promotions, leave one loser, and readers see whole commits only. The numbers, not the files' times, say what is newest.

The folder must be on a file system whose rename is atomic and refuses to replace a file (HDFS and the like), or a local one, where a hard link does the same.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "kind string, version string, source string, folder string"


class Conflict(Exception):
    """Another writer committed something that this commit rests on."""


def _local(path: str) -> str | None:
    parts = urlparse(path)
    return parts.path if parts.scheme == "file" else path if not parts.scheme else None


def _folder(spark: SparkSession, path: str) -> str:
    """The log's folder; a path without a scheme is read as Spark reads it, in the default file system."""
    full = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    return full.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(full).toString()


def put_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one of its name; whether it was written."""
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"  # Spark doesn't read hidden files
    local = _local(path)
    if local is not None:
        hidden = _local(hidden)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(hidden, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(hidden, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    system = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(fs.Path(hidden), True)
    out.write(text.encode())
    out.close()
    try:
        context.rename(fs.Path(hidden), fs.Path(path), spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        return True
    except Exception:
        if system.exists(fs.Path(path)):
            return False
        raise
    finally:
        system.delete(fs.Path(hidden), False)


def newest(spark: SparkSession, path: str) -> int:
    """The number of the last commit, -1 before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, path))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return -1
    names = (s.getPath().getName() for s in system.listStatus(folder))
    return max((int(n[:-5]) for n in names if n[0] != "." and n.endswith(".json")), default=-1)


def history(spark: SparkSession, path: str) -> DataFrame:
    """number, kind (source, promote), version, source and folder of all commits."""
    if newest(spark, path) < 0:
        return spark.createDataFrame([], f"number bigint, {ENTRY}")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("bigint")
    return spark.read.schema(ENTRY).option("mode", "FAILFAST").json(_folder(spark, path)).select(number.alias("number"), "kind", "version", "source", "folder")


def _touches(entry: dict, other: dict) -> bool:
    """Whether a commit that came in between breaks what an entry rests on: the same source of a version, its promoted content, or what was live."""
    if entry["kind"] == "promote":
        return other["kind"] == "promote" or other["version"] == entry["version"]
    return other["version"] == entry["version"] and (other["kind"] == "promote" or other["source"] == entry["source"])


def commit(spark: SparkSession, path: str, entry: dict, since: int) -> int:
    """Put an entry (of the fields ENTRY) into the log and return its number. since: the newest commit that the writer had read before it began its work.

    Raises Conflict if a commit after it touches the entry. Commits in between are read one by one: as many as were made while the writer worked.
    """
    text = json.dumps({n.split()[0]: entry.get(n.split()[0]) for n in ENTRY.split(", ")})
    folder, number = _folder(spark, path), since + 1
    while not put_absent(spark, f"{folder}/{number:020d}.json", text):
        other = json.loads(_read(spark, f"{folder}/{number:020d}.json"))
        if _touches(entry, other):
            raise Conflict(f"commit {number} ({other['kind']} of {other['version']}) came before this {entry['kind']} of {entry['version']}")
        number += 1
    return number


def _read(spark: SparkSession, file: str) -> bytes:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """version, source and folder of the sources that were written whole; the highest commit of a source counts."""
    return history(spark, path).where("kind = 'source'").groupBy("version", "source").agg(F.max_by("folder", "number").alias("folder"))


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """version and status: the version promoted last is live, those before it are retired, all others staged."""
    rows = history(spark, path)
    live = rows.where("kind = 'promote'").agg(F.max_by("version", "number").alias("live"))  # one row
    promoted = rows.groupBy("version").agg(F.bool_or(F.col("kind") == "promote").alias("p"))
    status = F.when(~F.col("p"), "staged").when(F.col("version") == F.col("live"), "live").otherwise("retired")
    return promoted.join(F.broadcast(live)).select("version", status.alias("status"))


def promote(spark: SparkSession, path: str, version: str, failures: DataFrame, since: int) -> int:
    """Make a staged version live by one commit; the live one retires with it. failures: version, failed (promotion_failures).

    since: the newest commit when the checks began. A source of the version that was written anew since then, or another promotion, is a Conflict.
    """
    failed = sorted(r["failed"] for r in failures.where(F.col("version") == version).select("failed").distinct().collect())  # one of the nine checks each
    if not statuses(spark, path).where((F.col("version") == version) & (F.col("status") == "staged")).count():
        failed.append("not_staged")
    if failed:
        raise ValueError(f"version {version} fails {', '.join(failed)}")
    return commit(spark, path, {"kind": "promote", "version": version}, since)

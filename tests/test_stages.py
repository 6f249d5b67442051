"""Accounts of stages, snapshots of six tables, limits whose state expires."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from attesta.operators.stages import run_stages
from attesta.sources import files
from attesta.streaming.rate_limit import decide, rate_limit, rate_limit_stream


def test_accounts_equal_counted_rows(spark):
    rows = spark.range(1000).repartition(7).withColumn("v", F.col("id") % 13)
    stages = [("all", lambda d: d), ("few", lambda d: d.where("v < 3")), ("none", lambda d: None), ("sums", lambda d: d.groupBy("v").agg(F.count("*").alias("id"))), ("empty", lambda d: d.where("false"))]
    left, account = run_stages(rows, stages, {"n": F.sum("id"), "odd": F.count_if(F.col("id") % 2 == 1)})
    few = [i for i in range(1000) if i % 13 < 3]
    sums = [sum(i % 13 == v for i in few) for v in range(3)]
    want = [("all", "done", 1000, {"n": 499500, "odd": 500}), ("few", "done", len(few), {"n": sum(few), "odd": sum(i % 2 for i in few)}), ("none", "skipped", None, {}), ("sums", "done", 3, {"n": sum(sums), "odd": sum(i % 2 for i in sums)}), ("empty", "done", 0, {"n": 0, "odd": 0})]
    got = account.orderBy("position").collect()
    assert [(r.stage, r.status, r.rows, r.figures) for r in got] == want and left.count() == 0
    assert all((r.ms is None) == (r.status == "skipped") for r in got)


def test_a_failed_stage_ends_the_run(spark):
    fail = lambda d: d.withColumn("x", F.raise_error(F.lit("broken")))
    left, account = run_stages(spark.range(5), [("a", lambda d: d.where("id > 1")), ("b", fail), ("c", lambda d: d)])
    got = account.orderBy("position").collect()
    assert [(r.stage, r.status, r.rows) for r in got] == [("a", "done", 3), ("b", "failed", None), ("c", "skipped", None)] and "broken" in got[1].error
    assert sorted(r.id for r in left.collect()) == [2, 3, 4]


def test_snapshots_are_restored_whole(spark, tmp_path):
    row = spark.createDataFrame([(7, "v", "a"), (7, "v", None), (8, "w", "b")], "document_id int, version string, text string")
    tables = {n: row for n in (*files.TABLES, "versions")} | {"documents": spark.createDataFrame([(7, 1.5), (8, None)], "document_id int, x double")}
    kept = files.save_snapshot(tables, "v", str(tmp_path / "s"))
    assert {r.table: r.rows for r in kept.collect()} == dict.fromkeys([*files.TABLES, "versions"], 2) | {"documents": 1}
    back = files.load_snapshot(spark, str(tmp_path / "s"))
    assert back["documents"].collect() == [(7, 1.5)] and sorted(back["edges"].collect(), key=str) == sorted(row.where("version = 'v'").collect(), key=str)
    files.save_snapshot(tables, "nothing", str(tmp_path / "e"))
    assert all(t.count() == 0 for t in files.load_snapshot(spark, str(tmp_path / "e")).values())
    row.where("document_id = 7").withColumn("text", F.lit("a")).write.mode("overwrite").parquet(str(tmp_path / "s/edges"))
    with pytest.raises(ValueError, match="edges is not what was written"):
        files.load_snapshot(spark, str(tmp_path / "s"))


def allowed(rows, limit, window):
    out = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((t, e) for k, e, t in rows if k == key and t is not None)
        out |= {e: (key, a, round(w, 6)) for (_, e), (a, w) in zip(own, decide([t for t, _ in own], deque(), limit, window), strict=True)}
    return out | {e: (k, None, None) for k, e, t in rows if t is None}


def frame(spark, rows):
    return spark.createDataFrame(rows, "u string, e bigint, s double").select("u", "e", F.timestamp_millis((F.col("s") * 1000).cast("bigint")).alias("ts"))


def test_limits_of_long_and_odd_keys(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None, ""]), i, rnd.choice([None, *(float(rnd.randint(0, 900)) for _ in range(20))])) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)  # a key's events come in several frames
    try:
        got = {r.e: (r.u, r.allowed, r.retry_after) for r in rate_limit(frame(spark, rows), "u", "ts", "e", 3, 20.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == allowed(rows, 3, 20.0)
    assert rate_limit(frame(spark, rows).where("false"), "u", "ts", "e", 3, 20.0).collect() == []


def test_state_goes_after_a_quiet_window(spark, tmp_path):
    batches = [[("a", 1, 0.0), ("b", 2, 1.0), ("a", 3, 2.0)], [("a", 4, 3.0), ("a", 5, 11.5), ("b", 6, 12.0)], [("c", 7, 500.0)], [("d", 8, 501.0), ("a", 9, 502.0), ("a", 10, 20.0)]]
    schema = frame(spark, batches[0]).schema
    (tmp_path / "in").mkdir()
    stream = rate_limit_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "u", "ts", "e", 2, 10.0, delay="5 seconds")
    q = stream.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    states = []
    for batch in batches:
        frame(spark, batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    got = {r.e: (r.u, r.allowed, r.retry_after) for r in spark.table("limits").collect()}
    rows = [r for b in batches for r in b]
    assert got == allowed([r for r in rows if r[1] != 10], 2, 10.0)  # the last row is behind the watermark
    assert states == [2, 2, 1, 3]

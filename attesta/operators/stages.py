"""Stage accounting: stages of a run written one after the other, with rows and figures observed by the plans that write them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from attesta.session import shared_dir

ACCOUNT = "position int, stage string, status string, rows bigint, ms bigint, figures map<string, bigint>, error string"


def observed_write(df: DataFrame, path: str, figures: dict[str, Column] | None = None) -> dict[str, int]:
    """Write a table as Parquet, and return its rows and whole-number figures (aggregates): they are gathered while it is written, not by a second pass.

    Each task's figures come with its success, so a task that is run again counts once. A sum over no rows is 0.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(f.cast("bigint"), F.lit(0)).alias(n) for n, f in (figures or {}).items()]).write.parquet(path)
    return dict(seen.get)


def run_stages(rows: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame | None]]], figures: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that the stages leave, and the account of the run: position, stage, status, rows, ms, figures and error.

    A stage is a function from the rows of the one before (reread from the shared folder) to its own, or to None, which skips it: rows pass on. A stage
    that fails ends the run: its status is failed, those after it are skipped, and the rows are those of the last stage that was done.
    figures: aggregates over a stage's rows, by name. The account has a row a stage.
    """
    spark, account, failed = rows.sparkSession, [], False
    folder = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    for position, (name, stage) in enumerate(stages):
        began, status, seen, error = time.monotonic(), "skipped", {}, None
        try:
            out = None if failed else stage(rows)
            if out is not None:
                seen = observed_write(out, f"{folder}/{position}", figures)
                rows, status = spark.read.schema(out.schema).parquet(f"{folder}/{position}"), "done"
        except Exception as e:
            failed, status, error = True, "failed", str(e)
        ms = int((time.monotonic() - began) * 1000) if status != "skipped" else None
        account.append((position, name, status, seen.pop("rows", None), ms, seen, error))
    return rows, spark.createDataFrame(account, ACCOUNT)

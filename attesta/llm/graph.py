"""Connected components over DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import shared_dir


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction on links (u > v): every node ties neighbours to the least node it knows.

    A large star ties the greater neighbours, a small one the smaller neighbours and the node itself.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its least reachable node) of every node with a link; bigint ids, nulls link nothing.

    Alternates large and small stars until the links stay the same, in O(log^2 n) rounds even for
    long chains. Each round is checkpointed in the shared folder.
    """
    shared_dir(links.sparkSession)
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    mark = None
    while True:
        now = _stars(_stars(now, True), False).checkpoint()
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark or got[0] == 0:
            break
        mark = got
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

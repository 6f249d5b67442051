"""Trees and typed edges of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import materialize


def ancestors(nodes: DataFrame, seeds: DataFrame, depth: int = 4, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """seed, ancestor and distance, up to depth levels; a node that was met before isn't met again. The depth is small and fixed, so the joins are unrolled."""
    up = nodes.select(F.col(key).alias("_n"), F.col(parent).alias("_p")).where("_p IS NOT NULL")
    level, found = seeds.select(F.col(key).alias("seed"), F.col(key).alias("at")), []
    for i in range(1, depth + 1):
        level = level.join(up, F.col("at") == F.col("_n")).select("seed", F.col("_p").alias("at"))
        found.append(level.select("seed", F.col("at").alias("ancestor"), F.lit(i).alias("distance")))
    return reduce(DataFrame.unionByName, found).where("seed <> ancestor").groupBy("seed", "ancestor").agg(F.min("distance").alias("distance"))


def ancestors_in_version(nodes: DataFrame, seeds: DataFrame, depth: int, version: str = "version", key: str = "id", parent: str = "parent_id") -> DataFrame:
    """seed, version, ancestor and distance: parents of parents in the seed's version, for any depth.

    nodes: key, parent, version; seeds: key, version. A node is only left through its row in the seed's version, so a parent that another
    version holds is met, but not its own parents. What a seed has met is kept, so cycles end and each ancestor has its least distance; the
    seed itself is none. Each round works on the front of the last one, stored in the shared folder, and the rounds end with an empty front.
    """
    up = nodes.select(F.col(key).alias("_n"), F.col(version).alias("_v"), F.col(parent).alias("_p")).where("_p IS NOT NULL").distinct()
    front = seeds.select(F.col(key).alias("seed"), F.col(version).alias("_v"), F.col(key).alias("ancestor"), F.lit(0).alias("distance")).distinct()
    seen = front = materialize(front, "ancestors")
    for i in range(1, depth + 1):
        step = front.withColumnRenamed("ancestor", "_n").join(up, ["_n", "_v"]).select("seed", "_v", F.col("_p").alias("ancestor")).distinct()
        front = materialize(step.join(seen, ["seed", "_v", "ancestor"], "left_anti").withColumn("distance", F.lit(i)), "ancestors")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("distance > 0").withColumnRenamed("_v", version)


def expand(seeds: DataFrame, edges: DataFrame, kinds: list[str], depth: int = 1) -> DataFrame:
    """seed and reached: nodes within depth steps over edges (src, dst, kind) of the kinds, in either direction; seeds don't reach seeds of their own group again."""
    both = edges.where(F.col("kind").isin(kinds)).select("src", "dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = front = seeds.select("seed", F.col("node").alias("reached"))
    for _ in range(depth):
        front = front.join(both, F.col("reached") == F.col("src")).select("seed", F.col("dst").alias("reached")).distinct().join(seen, ["seed", "reached"], "left_anti")
        seen = seen.unionByName(front)
    return seen.join(seeds.select("seed", F.col("node").alias("reached")), ["seed", "reached"], "left_anti")


def resolve_edges(edges: DataFrame, nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Edges whose both ends exist, and those that are dropped."""
    known = nodes.select(F.col(key).alias("_k")).distinct()
    kept = edges.join(known, F.col("src") == F.col("_k"), "left_semi").join(known, F.col("dst") == F.col("_k"), "left_semi")
    return kept, edges.join(kept, edges.columns, "left_anti")


def related(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, kinds: list[str], depth: int = 4, hops: int = 1) -> DataFrame:
    """seed and reached: ancestors of each seed and what typed edges lead to, each once and without the seed itself. seeds: seed."""
    own = seeds.select("seed").distinct()
    up = ancestors(nodes, own.select(F.col("seed").alias("id")), depth).select("seed", F.col("ancestor").alias("reached"))
    out = expand(own.withColumn("node", F.col("seed")), edges, kinds, hops).select("seed", "reached")
    return up.unionByName(out).where("seed <> reached").distinct()


def orphan_parts(keys: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Keys of provisos and explanations that no proviso edge leads to."""
    targets = edges.where("kind = 'proviso_of'").select(F.col("dst").alias(key)).distinct()
    return keys.where(F.col(key).rlike("-(proviso|explanation)$")).join(targets, key, "left_anti").select(key)


def load_sections(units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections (units with section_id and parent_id), edges by ids, and the dropped edges (an end that isn't there).

    A section's id is made of its document and key, so loading again gives the same ids; a parent key that isn't there gives a null parent.
    """
    made = lambda doc, key: F.substring(F.sha2(F.concat_ws("|", doc, key), 256), 1, 32)
    sections = units.withColumn("section_id", made(F.col("doc").cast("string"), F.col("key")))
    ids = sections.select(F.col("doc").alias("_d"), F.col("key").alias("_k"), F.col("section_id").alias("_id")).distinct()
    parented = sections.join(ids, (F.col("doc") == F.col("_d")) & (F.col("parent") == F.col("_k")), "left").withColumnRenamed("_id", "parent_id").drop("_d", "_k")
    met = edges.join(ids.select(F.col("_d").alias("doc"), F.col("_k").alias("src"), F.col("_id").alias("src_id")), ["doc", "src"], "left").join(ids.select(F.col("_d").alias("doc"), F.col("_k").alias("dst"), F.col("_id").alias("dst_id")), ["doc", "dst"], "left")
    whole = F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()
    return parented, met.where(whole).select("doc", "src_id", "dst_id", "kind"), met.where(~whole).select("doc", "src", "dst", "kind")

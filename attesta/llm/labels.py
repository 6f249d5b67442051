"""Bounded labelled samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.session import materialize


def held_out(key: str, folds: int, fold: int):
    """Whether a row belongs to the fold whose labels are never learned from: crc32 of the id as text, modulo folds. A null id is in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def label_rows(labels: DataFrame, label: str, folds: int, fold: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and y of all training rows, and the classes' sizes.

    A document with several label rows counts as 1 if any of them is 1; null labels and null ids count for nothing.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return rows, {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}


def label_sample(labels: DataFrame, label: str, per_class: int, folds: int, fold: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and y of at most per_class training rows of each class, and the classes' sizes over all training rows.

    The sample holds the smallest hashes of doc_id, so it is the same in any partitioning. A document
    with several label rows counts as 1 if any of them is 1; null labels and null ids count for nothing.
    """
    rows, sizes = label_rows(labels, label, folds, fold)
    picked = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return picked[0].unionByName(picked[1]), sizes


def labelled_texts(docs: DataFrame, sample: DataFrame, class_bytes: int) -> DataFrame:
    """_doc, _text and y of the sampled documents; the sample is bounded, so it is broadcast.

    One row a doc_id: its shortest text, of the smallest hash. Of each class the texts in the order
    of the ids' hashes stay while they have at most class_bytes together (the first stays anyway).
    """
    ids = F.broadcast(sample.select(F.col("doc_id").alias("_id"), F.col("y").alias("_y")))
    size = F.coalesce(F.octet_length("_text"), F.lit(0))
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).join(ids, F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_doc").agg(F.min(F.struct(size.alias("size"), F.xxhash64("_text").alias("hash"), "_text")).alias("row"), F.first("_y").alias("y")).select("_doc", "row._text", "row.size", "y")
    rows = materialize(rows, "labelled-texts")
    before = Window.partitionBy("y").orderBy(F.xxhash64("_doc"), "_doc").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("_doc", "size", F.sum("size").over(before).alias("total"), F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("_doc"), "_doc")).alias("k"))
    return rows.join(F.broadcast(within.where((F.col("total") <= class_bytes) | (F.col("k") == 1)).select("_doc")), "_doc").select("_doc", "_text", "y")

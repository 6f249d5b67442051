"""Corpus pipeline: from raw documents to token ids.

Stages, each over all its predecessor kept: toxic documents go; of near-duplicates one stays; text
that an earlier document has is cut; documents with benchmark passages go; the rest is encoded.
The first four return the columns of documents, the last one doc_id, n_tokens, ids and the digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.bpe import bpe_round_trip
from attesta.llm.decontaminate import drop_contaminated
from attesta.llm.minhash import drop_near_duplicates
from attesta.llm.suffix import drop_repeats
from attesta.llm.toxicity import drop_toxic
from attesta.session import materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe_round_trip(docs, "text", "doc_id", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: The toxicity model is fitted here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

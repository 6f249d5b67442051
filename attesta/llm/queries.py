"""Queries of the training-data operators, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.llm.align import alignment_report
from attesta.llm.backtrack import backtrack_digests
from attesta.llm.bpe import bpe_digests, bpe_encode
from attesta.llm.decontaminate import PROXIMITY_SQL, contamination_report, proximity_report
from attesta.llm.decontaminate import REPORT_SQL as DECONTAMINATE_SQL
from attesta.llm.media import media_digests
from attesta.llm.minhash import near_duplicates
from attesta.llm.quality import quality_report
from attesta.llm.resample import REPORT_SQL as RESAMPLE_SQL
from attesta.llm.resample import resample_report
from attesta.llm.suffix import repeat_report
from attesta.llm.toxicity import toxicity_report
from attesta.llm.training_order import training_order
from attesta.llm.urls import filter_urls
from attesta.llm.warc import REPORT_SQL, derivative_report
from attesta.session import materialize, table


def op1_media_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's other half: places near a window's rarest terms, also where words between them were put in or left out."""
    return proximity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = bpe_encode(table(spark, sf_dir, "documents"), "text", "doc_id", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return training_order(spark, materialize(ids, "order-ids"), "ids", width=2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivative_report(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return backtrack_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_signatures": op1_media_signatures,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_training_order": op4_training_order,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_minhash": op9_minhash,
    "op10_quality": op10_quality,
    "op11_backtracking_bpe": op11_backtracking_bpe,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "benchmark_proximity": benchmark_proximity,
}

ORACLE_SQL: dict[str, str] = {"op2_decontaminate": DECONTAMINATE_SQL, "benchmark_proximity": PROXIMITY_SQL, "op6_warc_derivatives": REPORT_SQL, "op12_importance_resampling": RESAMPLE_SQL}

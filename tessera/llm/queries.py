"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.oracles import SQL as SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_array_dedup import suffix_array_dedup_query

    return suffix_array_dedup_query(_table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentencepiece_codec import sentencepiece_query

    return sentencepiece_query(_table(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_classifier import quality_query

    return quality_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import substring_dedup_query

    return substring_dedup_query(_table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import warc_query

    return warc_query(_table(spark, sf_dir, "pages"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality_rules_query

    return quality_rules_query(_table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash_forest import minhash_query

    return minhash_query(_table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import decontamination_query

    return decontamination_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import line_dedup_query

    return line_dedup_query(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": _op1,
    "op2_sentencepiece": _op2,
    "op3_quality_classifier": _op3,
    "op4_substring_dedup": _op4,
    "op5_token_counts": _op5,
    "op6_warc": _op6,
    "op7_quality_rules": _op7,
    "op8_minhash_forest": _op8,
    "op9_decontamination": _op9,
    "op10_line_dedup": _op10,
}

"""A corpus pipeline of the operators in tessera.llm; counted as part of that subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _store
from tessera.llm.decontamination import decontamination_stage
from tessera.llm.line_dedup import line_dedup_stage
from tessera.llm.minhash_forest import minhash_stage
from tessera.llm.quality_classifier import quality_stage
from tessera.llm.sentencepiece_codec import sentencepiece_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup_stage(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_stage(docs)


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_stage(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _quality),
    ("line_dedup", _lines),
    ("minhash_near_dedup", _near),
    ("benchmark_decontamination", _leaks),
    ("sentencepiece", _encode),
]

#: The classifier, the alignment and the encoding have no SQL form; brute force stands in for it in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _store.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

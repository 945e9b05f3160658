"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir) and returns what it keeps. Texts go to Python in small
batches, as all stages share the memory of the same executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import decontaminate, ngram_join, pieces, pii, quality
from recollect.session import small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows equal in id and text share their verdict."""
    small_batches(spark)
    return quality.keep_good(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    small_batches(spark)
    return ngram_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    small_batches(spark)
    return pii.masked(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (with begin and end) and the text they decode to."""
    small_batches(spark)
    return pieces.encoded(docs)

"""Documents to training text: quality rules, one document of each group of near copies, no benchmark
passages, no personal data, and token ids at the end. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import pipeline_stages as stages
from recollect.session import cut_lineage

STAGES = [
    ("quality rules", stages.quality_rules),
    ("n-gram Jaccard join", stages.ngram_join_stage),
    ("benchmark decontamination", stages.decontamination),
    ("PII", stages.personal_data),
    ("SentencePiece", stages.sentencepiece),
]

# The stages are not expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs

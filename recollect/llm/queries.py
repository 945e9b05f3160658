"""The registered queries of the operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import (alignment, conversations, decontaminate, language, licenses, near_vectors, ngram_join, oracle, pieces,
                           pii, quality, spans, substrings, token_file)
from recollect.llm.rows import documents
from recollect.session import checkpoint_dir


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("distance2", 6).alias("distance2"))


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/recollect-tokens-{uuid.uuid4().hex}"
    return token_file.read(spark, token_file.write(documents(spark, sf_dir), path), with_ids=False)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.evaluated(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.found(documents(spark, sf_dir)))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digests(documents(spark, sf_dir))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.links(documents(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = documents(spark, sf_dir, "conversations")
    return conversations.digests(table, conversations.damage(table))


QUERIES = {
    "op1_token_file": op1_token_file,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_suffix_array": op9_suffix_array,
    "op10_quality_rules": op10_quality_rules,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE = {
    "op7_sentence_spans": oracle.SENTENCE_SPANS,
    "op8_ngram_jaccard_join": oracle.NGRAM_JOIN,
    "op9_suffix_array": oracle.REPEATED_BYTES,
    "op12_embedding_near_dedup": oracle.NEAR_VECTORS,
    "op13_conversation_repair": oracle.CONVERSATIONS,
}

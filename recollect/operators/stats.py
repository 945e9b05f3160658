"""Counts over workspaces, messages and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import canonical_workspace, clean_space, token_estimate


def workspace_stats(rows: DataFrame) -> DataFrame:
    """Stored rows per workspace, and those a filtered read returns (the ones filed
    under the workspace's own name)."""
    home = canonical_workspace(F.col("workspace_id"))
    return rows.groupBy(home.alias("workspace")).agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if((F.col("workspace_id") == home) | F.col("workspace_id").startswith("_"))
        .alias("readable_rows"))


def health(stats: DataFrame, embedding_status: str = "ok") -> DataFrame:
    """Rows that cannot be read are never healthy."""
    base = {"degraded": "degraded", "unknown": "unknown"}.get(embedding_status, "healthy")
    lost = (F.col("document_count") > 0) & (F.col("readable_rows") == 0)
    return stats.withColumn("status", F.when(lost, "degraded").otherwise(base))


def analytics(rows: DataFrame) -> DataFrame:
    """D3: documents per workspace with a total row (workspace null)."""
    return rows.rollup("workspace_id").agg(F.count(F.lit(1)).alias("document_count"))


def chunks_per_message(rows: DataFrame) -> DataFrame:
    """D4."""
    return rows.groupBy("workspace_id", "message_id").agg(F.count(F.lit(1)).alias("chunks"))


def entity_top(rows: DataFrame, k: int = 10, items: str = "entities") -> DataFrame:
    """The most frequent entities, counted map-side; ties by name."""
    names = rows.select(F.explode(items).alias("entity")).withColumn("entity", clean_space(F.col("entity")))
    counted = names.where(F.col("entity") != "").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "entity").limit(k)


def tokens_used(rows: DataFrame, keys: list[str], text: str = "document") -> DataFrame:
    """D21."""
    return rows.groupBy(*keys).agg(F.sum(token_estimate(F.col(text))).alias("tokens"))


def recall(queries: DataFrame, results: DataFrame, expected: Column, answer: Column,
           key: str) -> DataFrame:
    """The share of queries with a result that contains the expected text. `results`
    holds a bounded hit list per query."""
    hit = F.contains(F.lower(answer), F.lower(expected))
    judged = queries.join(results, key, "left").groupBy(key).agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"))
    return judged.agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("queries"),
                      F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("recall"))


def owning_workspace(rows: DataFrame, hint: Column | None = None) -> DataFrame:
    """The workspace of each message, the hinted one first, else the first by name."""
    first = F.struct((F.col("workspace_id") != hint).cast("int").alias("other") if hint is not None
                     else F.lit(0).alias("other"), F.col("workspace_id"))
    return rows.groupBy("message_id").agg(F.min(first)["workspace_id"].alias("workspace_id"))

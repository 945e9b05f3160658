"""Dead knowledge: old rows that nothing cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import preview
from recollect.operators.predicates import timeless
from recollect.settings import STALE_DAYS


def reinforced(edges: DataFrame) -> DataFrame:
    """Every id an edge mentions, once per workspace."""
    named = F.concat(F.array("conclusion_id"), "premise_ids", "supporting_message_ids")
    return edges.select("workspace_id", F.explode(named).alias("id")).where("id <> ''").distinct()


def scan(messages: DataFrame, conclusions: DataFrame, edges: DataFrame, now: Column,
         max_age_days: int = STALE_DAYS) -> DataFrame:
    """Candidates of every workspace with their age; the caller orders and limits them.

    Messages are read by their first chunk and age-filtered before the anti-join, so that only
    old rows are shuffled, with a preview in place of their text.
    """
    cutoff = F.timestamp_micros(F.unix_micros(now) - max_age_days * 86_400_000_000)
    mentioned = reinforced(edges)
    first = messages.where((F.col("chunk_index") == 0) & (F.col("created_at") <= cutoff)).where(
        ~timeless(F.col("role"), F.col("importance")))
    shown = preview(F.col("document"), 200).alias("document")
    cited = F.when(F.col("role") == "assistant",
                   "old assistant output, never cited as premise or support").otherwise(
                       "old, never reinforced by any reasoning edge")
    old_messages = first.select(
        "workspace_id", F.col("message_id").alias("id"), F.lit("message").alias("kind"),
        shown, "created_at", F.coalesce("importance", F.lit(0.0)).alias("importance"), cited.alias("reason"))
    old_conclusions = conclusions.where(F.col("created_at") <= cutoff).select(
        "workspace_id", "id", F.lit("conclusion").alias("kind"), shown, "created_at",
        F.lit(0.0).alias("importance"), F.lit("old conclusion, never used as premise").alias("reason"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("created_at"))) / 86.4e9
    return (old_messages.unionByName(old_conclusions)
            .join(mentioned, ["workspace_id", "id"], "left_anti")
            .withColumn("age_days", age))


def report(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """oldest first. The limit follows the sort."""
    limit = limit if limit > 0 else 50
    return candidates.orderBy(F.col("age_days").desc(), "id").limit(limit)

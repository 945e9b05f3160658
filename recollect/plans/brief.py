"""The session-start overview of every workspace, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import clean_space
from recollect.operators import context, stale
from recollect.operators.skew import top_per_key


def top_entities(chunks: DataFrame, k: int = 10) -> DataFrame:
    """D10 per workspace: counted first, then the best `k` of each."""
    counted = (chunks.select("workspace_id", F.explode("entities").alias("entity"))
               .withColumn("entity", clean_space(F.col("entity"))).where("entity <> ''")
               .groupBy("workspace_id", "entity").agg(F.count(F.lit(1)).alias("n")))
    top = top_per_key(counted, ["workspace_id"], [F.col("n").desc(), F.col("entity")], k)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda e: e["entity"])
    return top.groupBy("workspace_id").agg(names.alias("top_entities"))


def brief(chunks: DataFrame, sessions: DataFrame, conclusions: DataFrame, edges: DataFrame,
          now: Column, max_conclusions: int = 10, max_age_days: int = stale.STALE_DAYS) -> DataFrame:
    """Every part is one row per workspace, so the joins are between small tables."""
    k = max_conclusions if max_conclusions > 0 else 10
    docs = chunks.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("document_count"))
    seen = sessions.groupBy("workspace_id").agg(F.countDistinct("session_id").alias("session_count"))
    told = context.representation(conclusions, k).withColumnRenamed("conclusions", "conclusion_count")
    old = stale.scan(chunks, conclusions, edges, now, max_age_days).groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("stale_count"))
    out = docs
    for part in (seen, told, top_entities(chunks), old):
        out = out.join(part, "workspace_id", "left")
    return out.fillna(0, ["session_count", "conclusion_count", "stale_count"])

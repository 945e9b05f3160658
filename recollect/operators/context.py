"""Session context: neighbours, token budgets and representations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import first_bytes, token_estimate
from recollect.operators.skew import join_lookup, running, top_per_key
from recollect.settings import CONTEXT_TOKENS


def within_budget(messages: DataFrame, budget: int = CONTEXT_TOKENS,
                  keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Per session the newest messages whose tokens fit the budget, without their texts;
    `used` is the running sum. Weights are never negative, so this stops where the first
    overflow does. Only keys, times and token numbers are shuffled."""
    newest = [F.col("created_at").desc(), F.col("message_id").desc()]
    rows = messages.select(*keys, "message_id", "created_at", token_estimate(F.col("document")).alias("tokens"))
    return running(rows, list(keys), newest, F.col("tokens"), rank="newest", total="used").where(
        F.col("used") <= budget)


def fit_representation(text: Column, budget: int = CONTEXT_TOKENS) -> tuple[Column, Column]:
    """The representation cut to the budget, and the tokens left for messages."""
    left = F.lit(budget) - token_estimate(text)
    return F.when(left < 0, first_bytes(text, budget * 4)).otherwise(text), F.greatest(left, F.lit(0))


def around(messages: DataFrame, targets: DataFrame, window: int = 2,
           keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """For each target message the ids up to `window` places before and after it in its
    session, with their `offset`. Messages are numbered by key and time alone, without gathering
    a session, then looked up by number."""
    window = window if window > 0 else 2
    keys = list(keys)
    numbered = running(messages.select(*keys, "message_id", "created_at"), keys,
                       [F.col("created_at"), F.col("message_id")], rank="place").drop("running")
    wanted = numbered.join(targets.select("message_id"), "message_id", "left_semi").select(
        *keys, F.col("message_id").alias("target_id"), F.col("place").alias("target_place"),
        F.explode(F.sequence(F.col("place") - window, F.col("place") + window)).alias("place"))
    return wanted.join(numbered, [*keys, "place"]).withColumn(
        "offset", F.col("place") - F.col("target_place"))


def representation(conclusions: DataFrame, max_conclusions: int = 25,
                   keys: tuple[str, ...] = ("workspace_id",)) -> DataFrame:
    """The newest conclusions of each key as one bulleted text (a bounded list)."""
    k = max_conclusions if max_conclusions > 0 else 25
    # ids are ranked, then the texts of the few that are kept are looked up
    top = top_per_key(conclusions.select(*keys, "id", "created_at"), list(keys),
                      [F.col("created_at").desc(), F.col("id")], k)
    top = join_lookup(conclusions.select(*dict.fromkeys([*keys, "id"]), "document"), top, list(dict.fromkeys([*keys, "id"])), "inner")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document"))),
                        lambda c: F.concat(F.lit("- "), c["document"]))
    return top.groupBy(*keys).agg(F.concat_ws("\n", lines).alias("representation"),
                                  F.count(F.lit(1)).alias("conclusions"))


def scope_rows(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """The rows of each scope's sessions."""
    members = scopes.select("workspace_id", "scope_name", F.explode("sessions").alias("session_id"))
    return rows.join(members.distinct(), ["workspace_id", "session_id"])

"""The inbox of deferred updates, as table transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.dml import MESSAGE, latest, upsert
from recollect.settings import PENDING_ATTEMPTS, PENDING_CAPACITY, PENDING_RETENTION_SECONDS

# No canonical workspace name begins with an underscore.
ANY_WORKSPACE = "_any"


def enqueue(inbox: DataFrame, updates: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The last update of a message replaces what was queued for it and starts anew. Updates
    without a message, or without content and sections, are refused; one without a workspace waits
    under a name of its own until its owner is looked up."""
    fine = (F.coalesce("message_id", F.lit("")) != "") & (
        (F.coalesce("content", F.lit("")) != "") | (F.coalesce(F.size("sections"), F.lit(0)) > 0))
    named = updates.where(fine).withColumn(
        "workspace_id", F.coalesce(F.nullif("workspace_id", F.lit("")), F.lit(ANY_WORKSPACE)))
    fresh = latest(named, MESSAGE, order or ["queued_at"])
    fresh = fresh.withColumns({
        "status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string"),
        "applied_at": F.lit(None).cast("timestamp")})
    return upsert(inbox, fresh.select(*inbox.columns), MESSAGE)


def evict(inbox: DataFrame, capacity: int = PENDING_CAPACITY) -> DataFrame:
    """The inbox with at most `capacity` pending entries, the oldest leaving first. Only for
    parity: a table has no need of a bound."""
    kept = inbox.where("status = 'pending'").orderBy(F.col("queued_at").desc(), "message_id").limit(capacity)
    return inbox.where("status <> 'pending'").unionByName(kept)


def ready(inbox: DataFrame) -> DataFrame:
    """what a replay takes."""
    return inbox.where("status = 'pending'").orderBy("queued_at", "message_id")


def settle(inbox: DataFrame, outcomes: DataFrame, now: Column,
           max_attempts: int = PENDING_ATTEMPTS) -> DataFrame:
    """The inbox after a replay. `outcomes` are (workspace_id, message_id, error), the error null on
    success; failed entries wait for another try until they used up all of them."""
    joined = inbox.join(outcomes.select(*MESSAGE, "error").withColumn("_tried", F.lit(True)), MESSAGE, "left")
    failed = F.col("error").isNotNull()
    tries = F.col("attempts") + failed.cast("int")
    status = (F.when(~failed, "applied").when(tries >= max_attempts, "failed").otherwise("pending"))
    touched = F.coalesce("_tried", F.lit(False))
    change = lambda c, new: F.when(touched, new).otherwise(F.col(c)).alias(c)
    return joined.select(
        *[c for c in inbox.columns if c not in ("status", "attempts", "last_error", "applied_at")],
        change("status", status), change("attempts", tries), change("last_error", F.col("error")),
        change("applied_at", F.when(status != "pending", now)))


def prune(inbox: DataFrame, now: Column, seconds: int = PENDING_RETENTION_SECONDS) -> DataFrame:
    """Finished entries leave after the retention time."""
    age = (F.unix_micros(now) - F.unix_micros("applied_at")) / 1e6
    return inbox.where(~(F.col("status").isin("applied", "failed") & F.coalesce(age > seconds, F.lit(False))))

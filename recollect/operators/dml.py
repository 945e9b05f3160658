"""Row changes as DataFrame operations: what a write keeps, replaces and drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import chunk_plain, content_hash, keep_metadata, strip_nul, csv_list
from recollect.operators.skew import absent, first_seen
from recollect.settings import CHUNK_SIZE

# What identifies a message: ids are unique inside a workspace only.
MESSAGE = ["workspace_id", "message_id"]


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace the stored ones with the same key."""
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(
        incoming, allowMissingColumns=True)


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """A10."""
    return stored.join(gone.select(*keys), keys, "left_anti")


def delete_where(stored: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is unknown stay."""
    return stored.where(~F.coalesce(condition, F.lit(False)))


def expire(stored: DataFrame, older_than: Column) -> DataFrame:
    """What is left after a time limit; rows without a time stay."""
    return delete_where(stored, F.col("created_at") < older_than)


def unique_content(incoming: DataFrame, keys: list[str], order: list[Column],
                   stored: DataFrame | None = None) -> DataFrame:
    """The first row of each content hash that is not stored yet."""
    fresh = first_seen(incoming, keys, order)
    return fresh if stored is None else absent(fresh, stored, keys)


def to_chunks(messages: DataFrame) -> DataFrame:
    """L1, E5: validated messages as chunk rows, without vectors. The pieces of a message are
    made inside its row, so nothing is shuffled."""
    text = strip_nul(F.col("content"))
    extra = keep_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    field = lambda k: F.try_element_at(F.col("extra"), F.lit(k))
    cut_up = messages.withColumns({
        "extra": extra, "_parts": chunk_plain(text, CHUNK_SIZE),
        "content_hash": content_hash(F.col("workspace_id"), F.col("session_id"), text)}).drop("content", "metadata")
    # an inner explode would have Spark cut every text a second time, for a filter on empty lists
    rows = cut_up.select("*", F.posexplode_outer("_parts").alias("chunk_index", "document")).where("chunk_index IS NOT NULL")
    return rows.select(
        F.concat("message_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("id"),
        "message_id", "workspace_id", "session_id", "role", "document", "created_at", "chunk_index",
        F.size("_parts").alias("total_chunks"), "content_hash",
        F.nullif("scope", F.lit("")).alias("scope"), F.nullif("peer_id", F.lit("")).alias("peer_id"),
        F.lit(None).cast("array<string>").alias("peer_ids"),
        *[field(k).alias(k) for k in ("source_type", "source_path", "header_path", "chunk_type")],
        csv_list(field("tags")).alias("tags"), field("importance").try_cast("double").alias("importance"),
        *[field(k).alias(k) for k in ("agent", "language", "parent_doc_id", "doc_title")],
        field("chunk_id").alias("vault_chunk_id"), field("file_hash").alias("file_hash"),
        csv_list(field("entities")).alias("entities"), field("summary_1line").alias("summary_1line"),
        F.lit(None).cast("map<string,string>").alias("extra"))


def chunk_diff(edits: DataFrame, old: Column, new: Column) -> DataFrame:
    """The chunks of each edited message with the action for each: `keep` equal
    ones, `write` changed or added ones, `delete` the tail that is gone. `old` and `new` are the
    chunk lists of a row, so they are compared inside it and nothing is shuffled."""
    pairs = edits.select("*", F.posexplode(F.arrays_zip(old.alias("old"), new.alias("new")))
                         .alias("chunk_index", "_pair"))
    before, after = F.col("_pair")["old"], F.col("_pair")["new"]
    action = F.when(after.isNull(), "delete").when(before.eqNullSafe(after), "keep").otherwise("write")
    return pairs.withColumns({"document": after, "action": action}).drop("_pair")


def stale_tail(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored chunks past the end of their message's new version."""
    lengths = incoming.groupBy(*MESSAGE).agg(F.max("total_chunks").alias("_n"))
    return stored.join(lengths, MESSAGE).where(F.col("chunk_index") >= F.col("_n")).drop("_n")


def reassemble(chunks: DataFrame) -> DataFrame:
    """the chunks of each message in order, and its text; equal chunk ids are taken once."""
    once = first_seen(chunks.select("id", *MESSAGE, "chunk_index", "document"), ["workspace_id", "id"],
                      [F.col("chunk_index")])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "document"))),
                        lambda c: c["document"])
    return once.groupBy(*MESSAGE).agg(parts.alias("parts")).withColumn("text", F.array_join("parts", ""))


def latest(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """J5, batch form: the last update of each message wins, by a partial aggregate. `order`
    has to tell the updates of a message apart."""
    body = [c for c in updates.columns if c not in keys]
    last = F.max_by(F.struct(*body), F.struct(*order)).alias("_u")
    return updates.groupBy(*keys).agg(last).select(*keys, "_u.*")


def add_sessions(scopes: DataFrame, name: str, sessions: list[str]) -> DataFrame:
    """G6."""
    merged = F.array_union("sessions", F.array(*[F.lit(s) for s in sessions]).cast("array<string>"))
    return scopes.withColumn("sessions", F.when(F.col("scope_name") == name, merged)
                             .otherwise(F.col("sessions")))


def remove_session(scopes: DataFrame, name: str, session: str) -> DataFrame:
    """G6."""
    return scopes.withColumn("sessions", F.when(
        F.col("scope_name") == name, F.array_remove("sessions", session)).otherwise(F.col("sessions")))


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """G4."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def reconcile(live: DataFrame, restored: DataFrame, key: str) -> DataFrame:
    """Per key the row counts of both sides and their status."""
    a = live.groupBy(key).agg(F.count(F.lit(1)).alias("live_rows"))
    b = restored.groupBy(key).agg(F.count(F.lit(1)).alias("restored_rows"))
    status = (F.when(F.col("restored_rows").isNull(), "missing")
              .when(F.col("live_rows").isNull(), "extra")
              .when(F.col("live_rows") == F.col("restored_rows"), "equal").otherwise("differs"))
    return a.join(b, key, "full_outer").withColumn("status", status)

"""Structured Streaming: usage roll-ups, deduplication, derivation, write-back (2.J)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.functions.text import chunk_plain
from recollect.operators import pending, usage
from recollect.operators.skew import absent, first_seen, running
from recollect.session import checkpoint_dir, cut_lineage
from recollect.sources import sinks
from recollect.sources.brain import Brain
from recollect.streaming.groups import in_groups

FACT_BYTES = 8000
FACT_PROMPT = "Extract 1-3 concise facts/preferences about the peer from:\n"


def parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8,
                   glob: str = "*.parquet") -> DataFrame:
    """A folder of Parquet files as a replayable stream; the trigger bound is the admission
    control that a bounded queue would be (J2), without its losses."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("pathGlobFilter", glob).parquet(path))


def usage_counts(lines: DataFrame) -> DataFrame:
    """Counts per local day, action and agent."""
    return usage.normalise(lines).groupBy("day", "agent", "action").agg(F.count(F.lit(1)).alias("n"))


def start_counts(lines: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends what each batch adds to the counts. There is no watermark, so a line counts however late it
    comes, and no state but the stored counts; a batch that is run again overwrites its own folder, so each
    counts once."""
    def store(batch: DataFrame, batch_id: int) -> None:
        usage_counts(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (lines.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start())


def total_counts(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The counts of all batches that `start_counts` wrote."""
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum("n").alias("n"))


def start_unique(rows: DataFrame, keys: list[str], order: list[Column], out: str, checkpoint: str,
                 **trigger) -> StreamingQuery:
    """Keeps the first row of each key, however far apart its repeats come: a batch is reduced to
    one row for each key and then to keys that no other batch has stored. A batch that is run again
    leaves its own folder out of account and overwrites it."""
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = cut_lineage(first_seen(batch, keys, order))
        try:
            stored = spark.read.parquet(out).where(F.col("batch") != batch_id).select(*keys)
            fresh = absent(fresh, stored, keys)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (rows.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(store).trigger(**(trigger or {"availableNow": True})).start())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def derive(messages: DataFrame, brain: Brain, now: Column, per_group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conclusions and their edges from a table of messages (message_id, workspace_id,
    peer_id, content, created_at), those of a workspace in fives."""
    placed = running(messages, ["workspace_id"], [F.col("created_at"), F.col("message_id")], rank="place")
    return conclude(placed.withColumn("group", F.floor((F.col("place") - 1) / per_group)), brain, now)


def conclude(grouped: DataFrame, brain: Brain, now: Column) -> tuple[DataFrame, DataFrame]:
    """Conclusions and edges of messages with their `group` and `place`. A group longer than one prompt
    is spread over several, so no text is left out. Each prompt gives a conclusion per line."""
    groups = grouped.groupBy("workspace_id", "group").agg(
        F.array_sort(F.collect_list(F.struct("place", "message_id", "peer_id", "content"))).alias("m"))
    prompts = groups.select(
        "workspace_id", "group", F.col("m")[0]["peer_id"].alias("peer_id"),
        F.transform("m", lambda x: x["message_id"]).alias("message_ids"),
        F.posexplode(chunk_plain(F.array_join(F.transform("m", lambda x: x["content"]), "\n"), FACT_BYTES))
        .alias("part", "text"))
    said = prompts.withColumn("reply", summaries(F.concat(F.lit(FACT_PROMPT), "text"), brain, 400))
    lines = said.select("*", F.posexplode(F.split("reply", "\n")).alias("line", "fact")).withColumn(
        "fact", F.regexp_replace(F.trim("fact"), r"^[-*] ", "")).where("fact <> ''")
    made = cut_lineage(lines.select(
        F.concat(F.lit("concl_"), F.left(F.sha2(F.concat_ws(
            "|", "workspace_id", F.array_join("message_ids", ","), "part", "line"), 256), F.lit(24))).alias("id"),
        "workspace_id", "peer_id", F.col("fact").alias("document"), "message_ids", now.alias("created_at")))
    conclusions = made.select("id", "workspace_id", "peer_id", "document", "created_at",
                              F.lit("deriver").alias("source"))
    edges = made.select(
        F.concat(F.lit("edge_"), "id").alias("id"), "workspace_id", "peer_id", F.col("id").alias("conclusion_id"),
        F.array().cast("array<string>").alias("premise_ids"),
        F.col("message_ids").alias("supporting_message_ids"), "created_at")
    return conclusions, edges


def summaries(text: Column, brain: Brain, max_chars: int) -> Column:
    """K3 as a column."""
    def summarise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: brain.summarize(t.removeprefix(FACT_PROMPT), max_chars))

    summarise.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(summarise, "string")(text)


def start_deriver(messages: DataFrame, brain: Brain, store, checkpoint: str, **trigger) -> StreamingQuery:
    """J1 as a stream: `store(conclusions, edges)` keeps what a batch derived. Five messages of a workspace
    make a group, however batches cut the stream; fewer are derived two seconds after the first of them. A run
    over what is there (`availableNow`) has nothing to wait for and derives the rest of each batch at once. Ids
    follow from the messages, so a repeated batch stores the same rows again."""
    trigger = trigger or {"processingTime": "2 seconds"}
    wait = 2.0 if "processingTime" in trigger else 0.0

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store(*conclude(batch, brain, F.current_timestamp()))

    return (in_groups(messages, wait=wait).writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(run).trigger(**trigger).start())


def start_writeback(messages: DataFrame, root: str, checkpoint: str, workspaces: str = "",
                    owners: tuple[str, ...] = (), **trigger) -> StreamingQuery:
    """Session files kept up to date."""
    wanted = messages.where(sinks.allowed(F.col("workspace_id"), workspaces))

    def run(batch: DataFrame, _: int) -> None:
        sinks.write_session_files(sinks.turn_blocks(batch, owners), root)

    return (wanted.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
            .trigger(**(trigger or {"processingTime": "2 seconds"})).start())


def start_inbox(updates: DataFrame, tables, checkpoint: str, **trigger) -> StreamingQuery:
    """Queued updates kept in the pending table, the last one of a message winning."""
    def run(batch: DataFrame, _: int) -> None:
        tables.merge("pending", pending.enqueue(tables.read("pending").limit(0), batch))

    return (updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
            .trigger(**(trigger or {"processingTime": "2 seconds"})).start())


def recoveries(probes: DataFrame) -> DataFrame:
    """The probes (provider, at, status) at which a provider came back, or was first seen
    well. A probe is compared with the one numbered before it."""
    placed = running(probes.select("provider", "at", "status"), ["provider"], [F.col("at")], rank="place").drop("running")
    before = placed.select("provider", (F.col("place") + 1).alias("place"), F.col("status").alias("before"))
    known = placed.join(before, ["provider", "place"], "left")
    return known.where((F.col("status") == "ok") & ~F.col("before").eqNullSafe(F.lit("ok"))).drop("place", "before")

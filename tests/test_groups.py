"""Groups of five in a stream: the same for any batches, flushed by a timer, safe over a restart."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from recollect.sources.brain import ExtractiveBrain
from recollect.streaming import feeds
from recollect.streaming.groups import GROUPED, in_groups

SCHEMA = "message_id STRING, workspace_id STRING, peer_id STRING, content STRING, created_at TIMESTAMP"


def _feed(spark, folder, cuts):
    """38 messages of three workspaces, one file after the other."""
    rows = [(f"m{i:02}", [None, "a", "b"][min(i % 4, 2)], None if i % 3 else "p", f"Fact {i}.", i) for i in range(38)]
    rows.append((None, "a", None, None, 99))
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        part = rows[lo:hi][::-1]
        spark.createDataFrame([r[:4] for r in part], SCHEMA.rsplit(",", 1)[0]).withColumn(
            "created_at", F.timestamp_seconds(F.lit(1_760_000_000) + F.coalesce(
                F.substring("message_id", 2, 2).cast("int"), F.lit(99)))).coalesce(1).write.mode("append").parquet(folder)
    return rows


def _start(spark, feed, out, checkpoint, files, wait, **trigger):
    stream = feeds.parquet_stream(spark, feed, spark.read.parquet(feed).schema, files)
    grouped = in_groups(stream, wait=wait)
    return (grouped.writeStream.option("checkpointLocation", checkpoint).format("parquet").option("path", out)
            .trigger(**trigger).start())


def _groups(spark, out):
    rows = spark.read.parquet(out).groupBy("workspace_id", "group").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "message_id"))), lambda x: x["message_id"]).alias("ids"))
    return {(r["workspace_id"], r["group"]): r["ids"] for r in rows.collect()}


def _expected(rows, whole_only=True):
    want = {}
    for name in (None, "a", "b"):
        ids = [r[0] for r in rows if r[1] == name]
        for g in range(len(ids) // 5 if whole_only else -(-len(ids) // 5)):
            want[name, g] = ids[g * 5:g * 5 + 5]
    return want


@pytest.mark.parametrize("cuts", [[], [3, 4, 17, 30]])
def test_groups_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows = _feed(spark, str(tmp_path / "feed"), cuts)
    _start(spark, str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "ck"), 1, None,
           availableNow=True).awaitTermination()
    assert _groups(spark, str(tmp_path / "out")) == _expected(rows)


def test_restart_repeats_nothing_and_a_timer_flushes_the_rest(spark, tmp_path):
    rows = _feed(spark, str(tmp_path / "feed"), [7, 20])
    args = (spark, str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "ck"), 1, 1.0)
    query = _start(*args, processingTime="500 milliseconds")
    while not query.lastProgress or query.lastProgress["batchId"] < 1:
        time.sleep(0.2)
    query.stop()
    query = _start(*args, processingTime="500 milliseconds")
    late = ("m90", "c", "p", "A late fact.")
    spark.createDataFrame([late], SCHEMA.rsplit(",", 1)[0]).withColumn(
        "created_at", F.lit("2026-01-01 00:00:00").cast("timestamp")).write.mode("append").parquet(args[1])
    rows.append(late)
    for _ in range(60):
        if spark.read.schema(GROUPED).parquet(args[2]).count() == len(rows):
            break
        time.sleep(0.4)
    query.stop()
    got = _groups(spark, args[2])
    assert sorted(x for ids in got.values() for x in ids if x) == sorted(r[0] for r in rows if r[0])
    assert sum(len(ids) for ids in got.values()) == len(rows) and max(map(len, got.values())) == 5


def test_deriver_joins_messages_of_two_batches(spark, tmp_path):
    feed = str(tmp_path / "feed")
    _feed(spark, feed, [2, 9])
    stored = []
    stream = feeds.parquet_stream(spark, feed, spark.read.parquet(feed).schema, 1)
    query = feeds.start_deriver(stream, ExtractiveBrain(), lambda c, e: stored.extend(e.collect()), str(tmp_path / "ck"),
                                processingTime="1 second")
    for _ in range(60):
        cited = {tuple(r["supporting_message_ids"]) for r in stored}
        if sum(map(len, cited)) >= 38:
            break
        time.sleep(0.4)
    query.stop()
    ids = [x for c in cited for x in c if x]
    assert len(ids) == len(set(ids)) and max(map(len, cited)) <= 5
    assert {x for x in ids} == {f"m{i:02}" for i in range(38)}

"""Methods of the facade that stand on files, models and queues."""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle

from recollect.engine import Memory
from recollect.sources import files
from recollect.sources.brain import ExtractiveBrain
from recollect.sources.embedding import HashingEmbedder
from recollect.streaming import feeds

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Tagger(ExtractiveBrain):
    def chat(self, messages, temperature=0.3, max_chars=0):
        return json.dumps({"tags": "Green Tea, noon", "summary": "About tea.", "entities": "Carol"})


def test_auto_tagging_fills_what_is_missing(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "m"), HashingEmbedder(16), Tagger(), buckets=1, auto_tag=True)
    memory.add_message("w", "s", "user", "tea at noon")
    memory.add_message("w", "s", "user", "tagged already", metadata={"tags": "own"})
    rows = {r.document: r for r in memory.messages("w").collect()}
    assert rows["tea at noon"].tags == ["green-tea", "noon"] and rows["tea at noon"].summary_1line == "About tea."
    assert rows["tagged already"].tags == ["own"] and rows["tagged already"].entities == ["Carol"]
    assert {(r.workspace_id, r.chunks) for r in memory.message_sizes("w").collect()} == {("w", 1)}


def test_graph_neighbours(spark, tmp_path):
    nodes = spark.createDataFrame([(n, "doc", n) for n in "abcd"], "id STRING, type STRING, label STRING")
    edges = spark.createDataFrame([("a", "b", "links_to", 1.0), ("b", "c", "links_to", 1.0), ("d", "a", "links_to", 1.0)],
                                  "`from` STRING, `to` STRING, relation STRING, weight DOUBLE")
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    memory = Memory(spark, str(tmp_path / "m"), HashingEmbedder(16), buckets=1)
    assert [(r.id, r.hop) for r in memory.graph_neighbours(str(tmp_path / "g"), ["a"], 2).collect()] == [("b", 1), ("d", 1), ("c", 2)]


def test_inbox_stream_and_dreams(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "m"), HashingEmbedder(16), buckets=1)
    for w in ("wa", "wb"):
        for i in range(3):
            memory.add_message(w, "s", "user", f"{w} talks about tea number {i}.")
    assert memory.dream_all() == 2 and memory.dream_all() == 0
    first = memory.messages("wa").first()["message_id"]
    updates = spark.createDataFrame([(first, "wa", "changed")], "message_id STRING, workspace_id STRING, content STRING")
    memory.queue_updates(updates)
    assert [r.message_id for r in memory.pending_updates(waiting_only=True).collect()] == [first]
    memory.tables.read("pending").write.parquet(str(tmp_path / "feed"))
    stream = feeds.parquet_stream(spark, str(tmp_path / "feed"), memory.tables.schema("pending"))
    memory.start_inbox(stream, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert memory.pending_updates().count() == 1 and memory.drain()["applied"] == 1


def test_webhooks_by_event(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "m"), HashingEmbedder(16), buckets=1)
    free = lambda host: ["93.184.216.34"]
    memory.register_webhook("w", "https://a.example/x", ["stored"], free)
    memory.register_webhook("w", "https://b.example/x", [], free)
    assert memory.webhooks("w", "stored").count() == 2 and memory.webhooks("w", "deleted").count() == 1

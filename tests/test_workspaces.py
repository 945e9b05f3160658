"""Ids are unique inside a workspace only: writes, edits, searches and overviews keep workspaces apart."""

from __future__ import annotations

import sys

import pytest
from pyspark import cloudpickle

from recollect.engine import Memory
from recollect.sources.embedding import HashingEmbedder

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Picky(HashingEmbedder):
    """Refuses texts that say so."""

    def embed(self, texts):
        if any("refuse" in t for t in texts):
            raise ValueError("no vector")
        return super().embed(texts)


IN = "message_id STRING, workspace_id STRING, session_id STRING, role STRING, content STRING, scope STRING, peer_id STRING"


@pytest.fixture
def memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "store"), Picky(32), buckets=2)
    receipts = m.add_batch(spark.createDataFrame([
        ("x1", "wa", "s", "user", "green tea at noon", None, None), ("x1", "wb", "s", "user", "black coffee at noon", None, None),
        ("x2", "wc", "s", "user", "tea inside", "in", "p1"), ("x3", "wc", "s", "user", "tea outside", "out", "p2"),
        ("x4", "wa", "", "user", "no session", None, None)], IN)).collect()
    assert sorted((r.workspace_id, r.message_id, r.stored) for r in receipts) == [
        ("wa", "x1", True), ("wa", "x4", False), ("wb", "x1", True), ("wc", "x2", True), ("wc", "x3", True)]
    return m


def texts(df):
    return sorted(r["document"] for r in df.collect())


def test_each_workspace_keeps_its_message(memory):
    assert texts(memory.message("wa", "x1")) == ["green tea at noon"]
    assert texts(memory.message("wb", "x1")) == ["black coffee at noon"]


def test_an_edit_changes_one_workspace(memory, spark):
    memory.update_message("wa", "x1", content="white tea at noon")
    assert texts(memory.message("wa", "x1")) == ["white tea at noon"]
    assert texts(memory.message("wb", "x1")) == ["black coffee at noon"]
    memory.delete_message("wa", "x1")
    assert texts(memory.message("wb", "x1")) == ["black coffee at noon"]


def test_search_all_tells_equal_ids_apart(memory):
    for hybrid in (True, False):
        hits = memory.search_all("tea coffee at noon", 10, hybrid=hybrid).where("id = 'x1_chunk_0'").collect()
        assert sorted((h["workspace_id"], h["document"]) for h in hits) == [
            ("wa", "green tea at noon"), ("wb", "black coffee at noon")]


def test_hybrid_keeps_to_scope_and_peer(memory):
    assert texts(memory.search("tea", "wc", scope="in", hybrid=True)) == ["tea inside"]
    assert texts(memory.search("tea", "wc", peer="p2", hybrid=True)) == ["tea outside"]


def test_representations_keep_workspaces_apart(memory, spark):
    memory.add_conclusions(spark.createDataFrame(
        [("c1", "wa", "p", "likes tea"), ("c1", "wb", "p", "likes coffee")], "id STRING, workspace_id STRING, peer_id STRING, document STRING"))
    assert memory.representation("wa") == "- likes tea" and memory.representation("wb") == "- likes coffee"
    memory.delete_conclusion("wa", "c1")
    assert memory.representation("wa") == "" and memory.representation("wb") == "- likes coffee"


def test_drain_gives_every_entry_its_outcome(memory, spark):
    memory.queue_updates(spark.createDataFrame([
        ("x1", "wa", "new green tea"), ("x1", "wb", "please refuse this"), ("x3", "", "found by its owner"), ("ghost", "wa", "x")],
        "message_id STRING, workspace_id STRING, content STRING"))
    assert memory.drain() == {"applied": 2, "requeued": 2, "failed": 0}
    assert texts(memory.message("wa", "x1")) == ["new green tea"]
    assert texts(memory.message("wb", "x1")) == ["black coffee at noon"]
    assert texts(memory.message("wc", "x3")) == ["found by its owner"]
    status = {(r.workspace_id, r.message_id): (r.status, r.attempts, r.last_error) for r in memory.pending_updates().collect()}
    assert status[("wb", "x1")] == ("pending", 1, "embedding failed")
    assert status[("wa", "ghost")] == ("pending", 1, "message not found in any workspace")
    for _ in range(4):
        counts = memory.drain()
    assert counts == {"applied": 0, "requeued": 0, "failed": 2} and memory.drain() == {"applied": 0, "requeued": 0, "failed": 0}


def test_a_bound_caller_edits_its_workspace_only(memory, spark, tmp_path):
    bound = Memory(spark, str(tmp_path / "store"), Picky(32), buckets=2, only_workspace="wa")
    bound.update_messages(spark.createDataFrame([("wb", "x1", "taken over")], "workspace_id STRING, message_id STRING, content STRING"))
    assert texts(memory.message("wb", "x1")) == ["black coffee at noon"]

"""What a write, a new version or a removed file leaves behind: nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recollect.engine import Memory
from recollect.operators import usage
from recollect.sources import sinks
from recollect.sources.embedding import HashingEmbedder


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, str(tmp_path / "store"), HashingEmbedder(16), buckets=2)


def documents(memory, **where):
    rows = memory.tables.read("chunks")
    for c, v in where.items():
        rows = rows.where(F.col(c) == v)
    return sorted(r["document"] for r in rows.select("document").collect())


def test_rewritten_message_keeps_no_tail(memory):
    memory.add_message("wa", "s", "user", "long text " * 1_800, message_id="m1")
    memory.add_message("wb", "s", "user", "other long text " * 1_200, message_id="m1")
    assert len(documents(memory, workspace_id="wa")) > 1
    memory.add_message("wa", "s", "user", "new short", message_id="m1")
    assert documents(memory, workspace_id="wa") == ["new short"]
    assert len(documents(memory, workspace_id="wb")) > 1


def test_vault_files_that_shrink_or_go(memory, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("# One\nfirst\n# Two\nsecond\n# Three\nthird\n")
    (notes / "b.md").write_text("plain\n")
    registry = memory.index_vault("wv", str(notes))
    assert len(documents(memory)) == 4
    (notes / "a.md").write_text("# One\nfirst\n")
    registry = memory.index_vault("wv", str(notes), registry=registry)
    assert len(documents(memory, source_path="a.md")) == 1 and len(documents(memory)) == 2
    (notes / "b.md").unlink()
    memory.index_vault("wv", str(notes), registry=registry)
    assert documents(memory, source_path="b.md") == [] and len(documents(memory)) == 1


def test_turns_of_shared_ids(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('m1', 'wa', 's', 'user', 'a', TIMESTAMP '2026-01-01'), ('m1', 'wb', 's', 'user', 'b', TIMESTAMP '2026-01-01'),
        ('m1', 'wa', 's', 'user', 'a', TIMESTAMP '2026-01-01') AS t(message_id, workspace_id, session_id, role, content, created_at)""")
    assert sorted(r.file.split("/")[2] for r in sinks.turn_blocks(rows).collect()) == ["wa", "wb"]


def test_sliding_counts_of_a_hot_key(spark):
    """One key holds half of all events, all in one hour."""
    made = spark.range(4_000).select(
        F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 5 + 2).cast("long").alias("user"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pmod(F.col("id") * 7_919, F.lit(3_600)) * 1_000_000).alias("ts"))
    got = {(r.user, r.ts): (r.n, r.in_window) for r in usage.sliding_count(made, "user", F.col("ts"), 60).collect()}
    times = {}
    for r in made.collect():
        times.setdefault(r.user, []).append(r.ts)
    for user, own in times.items():
        for t in set(own):
            assert got[user, t] == (own.count(t), sum(0 <= (t - o).total_seconds() <= 60 for o in own))
    assert len(got) == sum(len(set(v)) for v in times.values())


def test_a_text_is_cut_once(spark):
    """No filter and no second use of the pieces cuts a text again, and each window is searched for its blank once."""
    from recollect.operators import dml

    rows = spark.createDataFrame([("w", "s", "user", "word " * 3_000, "", "", None, "m", None), ("w", "s", "user", "", "", "", None, "e", None)],
                                 "workspace_id STRING, session_id STRING, role STRING, content STRING, scope STRING, peer_id STRING, "
                                 "metadata MAP<STRING,STRING>, message_id STRING, created_at TIMESTAMP")
    made = dml.to_chunks(rows.repartition(1))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
    got = {(r.message_id, r.chunk_index): r for r in made.collect()}
    assert sorted(got) == [("e", 0), ("m", 0), ("m", 1), ("m", 2)]
    assert " ".join(got["m", i].document for i in range(3)) == "word " * 3_000
    assert len({r.content_hash for k, r in got.items() if k[0] == "m"}) == 1 and got["m", 0].total_chunks == 3

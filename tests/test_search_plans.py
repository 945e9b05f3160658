"""What the composite searches write and shuffle: numbers of all rows, metadata and texts of candidates only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recollect.plans import search
from recollect.session import cut_lineage

N = 3


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "chunks")
    n = F.col("id")
    table = spark.range(4000).select(
        F.concat(F.lit("c"), n.cast("string")).alias("id"), F.concat(F.lit("w"), (n % 4).cast("string")).alias("workspace_id"),
        F.lit("s").alias("session_id"), F.lit("user").alias("role"), F.lit("2026-01-01").cast("timestamp").alias("created_at"),
        F.lit(3.0).alias("importance"), F.lit("h").alias("header_path"), F.array(F.lit("t")).alias("tags"),
        F.array(F.lit("e")).alias("entities"), F.lit("").alias("scope"), F.lit("p").alias("peer_id"),
        F.when(n == 0, F.lit(None)).otherwise(F.concat(F.lit("note on tea number "), n.cast("string"))).alias("document"),
        F.when(n % 7 == 0, F.lit(None)).otherwise(F.array(F.cos(n), F.sin(n)).cast("array<float>")).alias("embedding"))
    table.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("kind", ["all", "all_semantic", "hybrid"])
def test_one_scan_keeps_numbers_only(rows, monkeypatch, kind):
    written = []

    def record(df):
        out = cut_lineage(df)
        written.append((df.columns, df._jdf.queryExecution().executedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(search, "cut_lineage", record)
    query, now = search.Query("tea number 77", [1.0, 0.0]), F.lit("2026-02-01").cast("timestamp")
    if kind == "hybrid":
        hits = search.hybrid(rows, query, N, search.Scope(workspace="w1"), now)
    else:
        hits = search.search_all(rows, query, N, now, 0.0, use_hybrid=kind == "all")
    assert [r["document"] is not None for r in hits.collect()] == [True] * N
    columns, plan, count = written[0]
    assert "document" not in columns and "embedding" not in columns and "tags" not in columns
    assert "Exchange" not in plan and count >= 1000
    for columns, plan, count in written[1:]:
        assert count <= 4 * 2 * 4 * N and "embedding" not in columns
        assert not any("Exchange" in line and "document" in line for line in plan.splitlines())


def test_searches_without_vectors_or_words(rows):
    query, now = search.Query("zzqq", [1.0, 0.0, 0.0]), F.lit("2026-02-01").cast("timestamp")
    assert search.hybrid(rows, query, N, search.Scope(workspace="w1"), now).count() == 0
    assert search.hybrid(rows, query, N, search.Scope(), now).count() == 0
    assert search.search_all(rows, query, N, now, 0.0).count() == 0
    worded = search.Query("tea", [1.0, 0.0, 0.0])
    assert search.hybrid(rows, worded, N, search.Scope(workspace="w1"), now).count() == N


def test_unscoped_texts_come_from_the_best_hit_after_reordering(spark):
    """The nearest vector is in w1; the one that the rerank puts first, by its words, is in w2."""
    kind = ("id STRING, workspace_id STRING, session_id STRING, role STRING, created_at STRING, importance DOUBLE, header_path STRING, "
            "tags ARRAY<STRING>, entities ARRAY<STRING>, document STRING, embedding ARRAY<FLOAT>")
    row = lambda id_, space, text, vector, weight=1.0: (
        id_, space, "s", "user", "2026-02-01 00:00:00", weight, "", [], [], text, vector)
    table = spark.createDataFrame([
        row("near", "w1", "nothing", [1.0, 0.0]), row("worded", "w2", "tea tea tea tea", [1.0, 0.05], 5.0), row("far", "w2", "no", [0.0, 1.0]),
        row("text1", "w1", "tea", None), row("text2", "w2", "tea", None)], kind).withColumn("created_at", F.col("created_at").cast("timestamp"))
    hits = search.hybrid(table, search.Query("tea", [1.0, 0.0]), 9, search.Scope(), F.lit("2026-02-01").cast("timestamp"))
    found = {r["id"] for r in hits.collect()}
    assert "text2" in found and "text1" not in found

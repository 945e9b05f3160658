"""The shapes of plans that matter on large tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recollect.engine import Memory
from recollect.functions.identifiers import query_terms
from recollect.operators import knn, lexical, predicates, skew, stale, usage
from recollect.plans import search
from recollect.settings import Settings
from recollect.sources.embedding import HashingEmbedder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    m = Memory(spark, str(tmp_path_factory.mktemp("plans")), HashingEmbedder(16), buckets=2,
               settings=Settings(embed_dimensions=16))
    m.add_message("w", "s", "user", "one fact about tea")
    return m


def test_search_prunes_workspaces(memory):
    rows = memory.tables.read("chunks").where(predicates.visible(workspace="w"))
    scan = plan(knn.with_distance(rows.select("id", "embedding"), [0.5] * 16).orderBy("distance").limit(3))
    assert "PartitionFilters: [" in scan and "workspace_id" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "TakeOrderedAndProject" in scan
    assert "document" not in scan.split("ReadSchema")[1]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.lit("x").alias("text")).write.parquet(str(tmp_path / "t"))
    scan = plan(spark.read.parquet(str(tmp_path / "t")).where(predicates.equals(k=1)).select("id"))
    assert "EqualTo(k,1)" in scan and "text" not in scan.split("ReadSchema")[1]


def test_texts_are_counted_without_a_shuffle(spark):
    rows = spark.createDataFrame([("a", "one two")], "id STRING, document STRING")
    shape = plan(lexical.term_frequencies(rows, query_terms("one two")))
    assert "Exchange" not in shape and "Python" not in shape and "Join" not in shape


def test_top_per_key_limits_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    shape = plan(skew.top_per_key(rows, ["k"], [F.col("id")], 3))
    assert shape.count("WindowGroupLimit") == 2


def test_counts_are_combined_before_the_shuffle(spark):
    lines = spark.createDataFrame([("search", "mcp", "a", "w")], "action STRING, source STRING, agent STRING, workspace STRING"
                                  ).withColumn("ts", F.current_timestamp())
    shape = plan(usage.daily(usage.normalise(lines)))
    assert shape.count("HashAggregate") == 2 and shape.count("Exchange") == 1


def test_old_rows_meet_citations_by_preview(spark):
    m = spark.createDataFrame([], "workspace_id STRING, message_id STRING, chunk_index INT, role STRING, document STRING, "
                                  "created_at TIMESTAMP, importance DOUBLE")
    c = spark.createDataFrame([], "workspace_id STRING, id STRING, document STRING, created_at TIMESTAMP")
    e = spark.createDataFrame([], "workspace_id STRING, conclusion_id STRING, premise_ids ARRAY<STRING>, "
                                  "supporting_message_ids ARRAY<STRING>")
    assert stale.scan(m, c, e, F.current_timestamp()).count() == 0


def test_an_empty_store_answers(spark, tmp_path):
    empty = Memory(spark, str(tmp_path / "none"), HashingEmbedder(16), buckets=2)
    assert empty.search("anything", "w").count() == 0
    assert empty.search("anything", "w", hybrid=True).count() == 0
    assert empty.search_all("anything").count() == 0
    assert empty.stale("w").count() == 0 and empty.brief("w").count() == 0
    assert empty.usage_daily(2).count() == 2 and empty.metrics().first()["chunks_total"] == 0


def test_default_width_vectors(spark, tmp_path):
    wide = Memory(spark, str(tmp_path / "wide"), HashingEmbedder(768), buckets=1)
    wide.add_message("w", "s", "user", "green tea is served at noon")
    wide.add_message("w", "s", "user", "the build runs at night")
    assert wide.search("when is green tea served", "w").first()["document"].startswith("green tea")


def test_requests_are_honoured():
    assert [search.wanted(n) for n in (0, 5, 101, None)] == [10, 5, 101, 10]

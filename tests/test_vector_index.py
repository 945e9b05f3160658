"""The vector index against exact search: recall, exactness, filters, changes, and what a search reads."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators.knn import in_parts, nearest, top_matches
from recollect.sources.vector_index import VectorIndex

SCHEMA = "workspace_id STRING, id STRING, embedding ARRAY<FLOAT>, role STRING"


def made(n, seed=0, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    v = centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, width))
    return [(f"w{i % 3}", f"r{seed}_{i:04d}", [float(x) for x in row], ("user", "system")[i % 2]) for i, row in enumerate(v)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = made(800) + [("w0", "zero", [0.0] * 16, "user"), ("w0", "wide", [1.0] * 17, "user"), ("w0", "none", None, "user"),
                        ("w1", "odd", [float("nan")] * 16, "user")]
    df = spark.createDataFrame(rows, SCHEMA)
    return df, VectorIndex.build(df, str(tmp_path_factory.mktemp("index") / "v"))


def ids(df):
    return [r.id for r in df.orderBy("distance", "id").collect()]


def test_reads_only_probed_folders(index):
    df, found = index
    plan = found.search(made(1, 9)[0][2], 5)
    assert found.probes < len(found.centres) // 2
    lists = found.rows().where(F.col("list").isin(3, -1))
    text = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in text
    read = found.rows().where(F.col("list").isin(3)).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("/list=3/" in r.f for r in read)
    assert plan.count() == 5


def test_exact_and_filtered(spark, index):
    df, found = index
    for k, q in enumerate(made(6, 4)):
        where = None if k % 2 else (F.col("workspace_id") == "w1") & (F.col("role") == "user")
        assert ids(found.search(q[2], 10, where, exact=True)) == ids(nearest(df, q[2], 10, where))
    # a filter that leaves fewer rows than are asked for
    where = F.col("id").isin("r0_0001", "r0_0400", "zero")
    assert set(ids(found.search(made(1, 5)[0][2], 10, where, exact=True))) == {"r0_0001", "r0_0400", "zero"}
    assert ids(found.search([1.0] * 17, 3)) == ["wide"]


def test_recall_of_many(spark, index):
    df, found = index
    asked = df.where("id like 'r0_%0'").select(F.col("id").alias("q"), "embedding")
    rows = df.where("size(embedding) = 16 and id not in ('zero', 'odd')").select("id", "embedding")
    matched = top_matches(*in_parts(asked, rows), ["q"], 10, "part")
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    true = {(r.q, r.id) for r in matched.collect()}
    got = found.search_many(asked, 10)
    assert len(true & {(r.q, r.id) for r in got.collect()}) >= 0.9 * len(true)
    exact = {(r.q, r.id) for r in found.search_many(asked, 10, F.col("id").like("r0%"), exact=True).collect()}
    assert exact == true


def test_refresh_equals_rebuild(spark, index, tmp_path):
    rows = made(300, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    found = VectorIndex.build(df, str(tmp_path / "v"), lists=10)
    changed = [(w, i, v[::-1] if k % 50 == 0 else v, r) for k, (w, i, v, r) in enumerate(rows) if k % 7] + made(40, 2)
    now = spark.createDataFrame(changed, SCHEMA)
    found.refresh(now)
    assert sorted((r.workspace_id, r.id, tuple(r.embedding)) for r in found.rows().collect()) == sorted(
        (r.workspace_id, r.id, tuple(r.embedding)) for r in now.collect())
    q = made(1, 3)[0][2]
    assert ids(found.search(q, 10, exact=True)) == ids(nearest(now, q, 10))
    found.refresh(now.limit(0))
    assert found.search(q, 3, exact=True).count() == 0


def test_empty(spark, tmp_path):
    found = VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "v"))
    assert found.search([1.0], 3).count() == 0

"""Blocks of vectors: memory by the block, odd vectors, ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from recollect.operators import knn
from recollect.sources import vector_index


def test_rows_meet_lists_some_at_a_time():
    """A batch of many rows is never compared with all lists at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["x"])
    parts = list(vector_index._slices([batch], 4096))
    assert max(p.num_rows for p in parts) * 4096 <= vector_index.CELLS
    assert pa.Table.from_batches(parts).column("x").to_pylist() == list(range(10_000))


def test_a_vector_without_numbers_hides_no_other(spark):
    """It matches nothing itself; a row near to the query counts whatever stands in its block."""
    kinds = "k STRING, workspace_id STRING, embedding ARRAY<FLOAT>"
    queries = spark.createDataFrame([("a", "w", [1.0, 0.0]), ("b", "w", [0.0, 1.0]), ("c", "w", [None, 1.0])], kinds)
    rows = spark.createDataFrame([("x", "w", [1.0, 0.1]), ("y", "w", [float("nan"), 1.0]), ("z", "w", [None, 1.0])], kinds)
    assert [r.k for r in knn.near_any(queries, rows, ["k"], 0.15).collect()] == ["a"]


@pytest.mark.parametrize("block", [3, 64])
def test_top_matches_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    v = rng.normal(size=(60, 4)).round(1)
    v[10:20] = v[0]  # copies: ties go by id
    data = [(f"r{i:02d}", "w", [float(x) for x in row]) for i, row in enumerate(v)] + [("nan", "w", [float("nan")] * 4), ("wide", "w", [1.0] * 5)]
    rows = spark.createDataFrame(data, "id STRING, workspace_id STRING, embedding ARRAY<DOUBLE>")
    got = {}
    for r in knn.top_matches(rows.withColumnRenamed("id", "q"), rows, ["q"], 5, block=block).collect():
        got.setdefault(r.q, []).append((round(r.distance, 9), r.id))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(len(v)):
        want = sorted((round(float(1 - unit[i] @ unit[j]), 9), f"r{j:02d}") for j in range(len(v)))
        assert [d for d, _ in sorted(got[f"r{i:02d}"])] == pytest.approx([d for d, _ in want[:5]])
    assert [i for _, i in sorted(got["wide"])] == ["wide"] and "nan" not in got
    assert {i for _, i in got["r00"]} == {"r00", "r10", "r11", "r12", "r13"}

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from recollect.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine):
    """Every pair of one label, then components by least ids."""
    def fit(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    ids = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = (np.array(rows[k][1], np.float32).astype(float) if fit(rows[k][1]) else None for k in (i, j))
            if a is None or b is None or rows[i][2] is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if float(a @ b) / math.sqrt(float(a @ a)) / math.sqrt(float(b @ b)) >= cosine:
                near[i].append(j)
                near[j].append(i)
    root = [None] * n
    for i in range(n):
        if root[i] is None:
            group, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            for j in group:
                root[j] = min(ids[k] for k in group)
    real = [None if r == -(1 << 63) else r for r in root]
    return Counter((r[0], len(near[i]), real[i], ids[i] == root[i]) for i, r in enumerate(rows))


def vectors(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    made = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, width))
    return [(int(k), [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 3))) for k, v in zip(rng.permutation(n), made)]


def found(spark, rows, cosine=near_vectors.COSINE):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("vec", "group", "unit", "root", "n", "tile", "kind"):
        df = df.withColumn(name, df.label)
    got = near_vectors.links(df, cosine)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize(("width", "spread", "tile_bytes"), [(64, 0.25, 2 << 20), (64, 0.3, 6_000), (5, 0.2, 400), (1, 1.0, 100), (20, 0.15, 2_000)])
def test_equals_all_pairs(spark, monkeypatch, width, spread, tile_bytes):
    monkeypatch.setattr(near_vectors, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(near_vectors, "PART", 7 if tile_bytes < 10_000 else 512)
    rows = vectors(width, 150, width, spread)
    assert found(spark, rows) == brute(rows, near_vectors.COSINE)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1), (8, [1.0, None, 3.0], 1),
            (9, [1.0, float("nan"), 3.0], 1), (10, [1.0, float("inf"), 3.0], 1), (11, [1.0, 2.0], 1), (12, [1e30, 2e30, 3e30], 1), (1, v, 1), (1, [9.0, -1.0, 0.0], 1),
            (None, v, 1), (1, None, 1), (13, [1e-40, 2e-40, 3e-40], 1)] + [(20 + k, [3.0, 0.0, -1.0], 7) for k in range(50)]
    assert found(spark, rows) == brute(rows, near_vectors.COSINE)


def test_threshold(spark):
    rows = [(k, [math.cos(a), math.sin(a)], 0) for k, a in enumerate(np.linspace(0, 3, 120))]
    for cosine in (0.5, 0.93, 0.999):
        assert found(spark, rows, cosine) == brute(rows, cosine)


def test_empty(spark):
    assert found(spark, []) == Counter()
    assert found(spark, [(1, None, 1)]) == Counter({(1, 0, 1, True): 1})


def test_stops_early():
    """Far vectors are told apart by the leading axes: no full product is taken."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 64)) * np.linspace(5, 0.1, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = near_vectors.Side(np.arange(40).tobytes(), np.ones(40, np.int64).tobytes(), x.tobytes(), x.astype(np.float32).tobytes(), 64)
    side.units = None
    side.units = np.full((40, 64), np.nan)  # would be met by a full product
    far = np.flatnonzero(x[:, 0] < 0), np.flatnonzero(x[:, 0] > 0.3)
    a, b = near_vectors.compare(side, side, *far, 0.99)
    assert not len(a) and not len(b)

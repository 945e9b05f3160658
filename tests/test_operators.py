"""Operators on small fixtures, against hand-made values and brute force."""

from __future__ import annotations

import math
import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.functions.text import chunk_plain
from recollect.functions.vectors import cosine_distance, norm
from recollect.operators import codegraph, dml, fusion, graph, knn, lexical, limiter, pending, predicates, provenance, skew


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, document STRING")


def scores(spark, terms, texts):
    found = {r["id"]: r["bm25"] for r in lexical.bm25(docs(spark, texts), terms).collect()}
    return [round(found.get(i, 0.0), 6) for i in range(len(texts))]


def test_bm25(spark):
    same = ["common common common"] * 3 + ["common common rare"]
    assert scores(spark, ["common"], same) == [0.165567] * 3 + [0.144871]
    assert scores(spark, ["rare"], same) == [0, 0, 0, 1.203973]
    assert scores(spark, ["target"], ["target", "target a b c d e f g h i j"]) == [0.276626, 0.135969]
    x = "alpha target one two three"
    assert scores(spark, ["target"], [x, "", x]) == [0.390192, 0, 0.390192]
    assert scores(spark, ["art"], ["start of work", "art", "none here"]) == [0.390192, 0.590862, 0]
    assert scores(spark, [], ["a", "b"]) == [0, 0]


def test_rrf(spark):
    ranks = lambda rows: spark.createDataFrame(rows, "id STRING, rank INT")
    fused = fusion.rrf([ranks([("a", 0), ("b", 3), ("d", 1)]), ranks([("a", 0), ("b", 0), ("c", 0)])], ["id"])
    got = {r["id"]: round(r["fused"], 5) for r in fused.collect()}
    assert got == {"a": 1.0, "b": 0.97619, "c": 0.5, "d": round((1 / 61) / (2 / 60), 5)}


def test_decay(spark):
    now = datetime(2026, 3, 1)
    rows = spark.createDataFrame(
        [(h, 0.30, now - timedelta(hours=h), r, i) for h, r, i in [
            (168, "user", 1.0), (336, "user", 1.0), (2328, "user", None), (2328, "system", 1.0), (2328, "user", 4.0)]],
        "h INT, distance DOUBLE, created_at TIMESTAMP, role STRING, importance DOUBLE")
    got = [round(r["distance"], 6) for r in fusion.decay(rows, F.lit(now)).orderBy("h", "importance", "role").collect()]
    assert sorted(got) == [0.3, 0.3, 0.3, 0.321752, 0.737881]


def test_rerank(spark):
    rows = spark.createDataFrame([
        ("1", 0.30, "notes about cats", None, None, None, None),
        ("2", 0.40, "docker backup guide", "Docker", ["docker", "ops"], 5.0, ["Docker", "Nginx"]),
        ("3", 0.70, "backup backup", None, None, None, None)],
        "id STRING, distance DOUBLE, document STRING, header_path STRING, tags ARRAY<STRING>, importance DOUBLE, "
        "entities ARRAY<STRING>")
    got = {r["id"]: (round(r["rerank"], 6), r["rank"]) for r in fusion.rerank(rows, ["docker", "backup"]).collect()}
    assert got == {"1": (0.575, 1), "2": (0.777076, 0), "3": (0.116551, 2)}


def test_cosine_paths_agree(spark):
    rng = random.Random(3)
    for width in (16, 200):
        vectors = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(20)] + [[0.0] * width]
        query = [rng.gauss(0, 1) for _ in range(width)]
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id INT, embedding ARRAY<FLOAT>")
        size = lambda v: math.sqrt(sum(x * x for x in v))
        want = [1 - (sum(a * b for a, b in zip(v, query)) / (size(v) * size(query)) if size(v) else 0) for v in vectors]
        plain = rows.select("id", cosine_distance("embedding", query).alias("d"))
        assert [r["d"] for r in plain.orderBy("id").collect()] == pytest.approx(want, abs=1e-5)
        stored = rows.withColumn("norm", norm(F.col("embedding"))).select(
            "id", cosine_distance("embedding", query, "norm").alias("d"))
        assert [r["d"] for r in stored.orderBy("id").collect()] == pytest.approx(want, abs=1e-5)


def test_nearest_plan_keeps_a_top_k(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding"))
    hits = knn.nearest(rows, [1.0, 0.0], 5)
    assert [r["rank"] for r in hits.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_near_any(spark):
    queries = spark.createDataFrame([("a", "w", [1.0, 0.0]), ("b", "w", [0.0, 1.0]), ("c", "w", [-1.0, 0.0]), ("d", "v", [1.0, 0.0])],
                                    "k STRING, workspace_id STRING, embedding ARRAY<FLOAT>")
    rows = spark.createDataFrame([("w", [1.0, 0.1]), ("w", [0.0, 2.0]), ("w", None), ("v", [1.0, 0.0, 0.0])],
                                 "workspace_id STRING, embedding ARRAY<FLOAT>")
    for block in (1, 512):
        got = knn.near_any(queries, rows, ["workspace_id", "k"], 0.15, block=block)
        assert sorted(r["k"] for r in got.collect()) == ["a", "b"]
    assert knn.other_widths(rows, 2).first()["unseen"] == 2


def hot_rows(spark, n=3000):
    """A third of all rows under one key, with many equal times."""
    rng = random.Random(5)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(50), i, rng.randrange(5)) for i in range(n)]


def test_running_matches_a_plain_pass(spark):
    rows = hot_rows(spark)
    df = spark.createDataFrame(rows, "k STRING, t INT, id INT, v INT")
    got = {r["id"]: (r["rn"], r["running"]) for r in
           skew.running(df, ["k"], [F.col("t").desc(), F.col("id")], F.col("v")).collect()}
    want, state = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        n, s = state.get(k, (0, 0))
        state[k] = (n + 1, s + v)
        want[i] = state[k]
    assert got == want


def test_join_lookup_both_ways(spark):
    rows = spark.createDataFrame([(k, i) for k, _, i, _ in hot_rows(spark, 600)], "k STRING, id INT")
    lookup = rows.select("k").distinct().withColumn("x", F.length("k"))
    small = skew.join_lookup(rows, lookup, ["k"], "inner")
    salted = skew.join_lookup(rows, lookup, ["k"], "inner", max_bytes=0)
    assert sorted(map(tuple, small.select("k", "id", "x").collect())) == sorted(map(tuple, salted.select("k", "id", "x").collect()))
    assert small.count() == 600


def test_pages(spark):
    rows = spark.range(500).select((499 - F.col("id")).alias("id"))
    for shallow in (10_000, 0):
        got = [r["id"] for r in skew.page(rows, [F.col("id")], 10, 95, shallow).collect()]
        assert sorted(got) == list(range(95, 105))


def test_differs_keeps_null(spark):
    rows = spark.createDataFrame([("a",), ("codeindex",), (None,)], "peer STRING")
    assert rows.where(predicates.differs(F.col("peer"), "codeindex")).count() == 2


@pytest.mark.parametrize("limit, seconds", [(2, 1.0), (3, 0.5), (1, 2.0)])
def test_rate_limit(spark, limit, seconds):
    rng = random.Random(limit)
    start = datetime(2026, 1, 1)
    log = [("hot" if i % 3 == 0 else f"k{rng.randrange(5)}", start + timedelta(milliseconds=rng.randrange(0, 40_000, 100)))
           for i in range(900)]
    rows = spark.createDataFrame(log, "k STRING, ts TIMESTAMP")
    got = {(r["k"], r["us"]): r["accepted"] for r in limiter.decisions(rows, "k", F.col("ts"), limit, seconds).collect()}
    want, passed = {}, {}
    width = int(seconds * 1_000_000)
    for k, ts in sorted(log, key=lambda r: r[1]):
        us = int((ts - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        q = passed.setdefault(k, deque())
        while q and q[0] <= us - width:
            q.popleft()
        take = len(q) < limit
        if take:
            q.append(us)
        want[(k, us)] = want.get((k, us), 0) + take
    assert got == want


def test_trace_stops_at_cycles(spark):
    edges = spark.createDataFrame([
        ("a", ["b"], ["m1"]), ("b", ["a", "c"], ["m1", " m2 "]), ("c", [], ["m3"])],
        "conclusion_id STRING, premise_ids ARRAY<STRING>, supporting_message_ids ARRAY<STRING>")
    seed = spark.createDataFrame([("a", "a")], "seed STRING, id STRING")
    got = {(r["id"], r["via"], r["depth"]) for r in provenance.trace_forward(edges, seed).collect()}
    assert got == {("b", "premise", 1), ("m1", "supported_by", 1), ("c", "premise", 2), ("m2", "supported_by", 2),
                   ("m3", "supported_by", 3)}
    back = spark.createDataFrame([("m3", "m3")], "seed STRING, id STRING")
    assert {(r["id"], r["depth"]) for r in provenance.trace_reverse(edges, back).collect()} == {("c", 1), ("b", 2), ("a", 3)}
    none = spark.createDataFrame([("zz", "zz")], "seed STRING, id STRING")
    assert provenance.trace_forward(edges, none).count() == 0


def brute_expand(edges, seed, hops, most):
    visited, frontier, found = {seed}, [seed], []
    for _ in range(hops):
        reached = []
        for node in frontier:
            near = {}
            for a, b, w in edges:
                for x, y, d in ((a, b, 0), (b, a, 1)):
                    if x == node and not (y.startswith("entity:") and w < 0.7):
                        near[y] = min(near.get(y, d), d)
            for y in sorted(near, key=lambda y: (near[y], y)):
                if y not in visited and len(found) < most:
                    visited.add(y)
                    found.append(y)
                    reached.append(y)
        frontier = reached
    return found


def test_expand(spark):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(12)] + ["entity:x", "entity:y"]
    edges = [(rng.choice(names), rng.choice(names), rng.choice([0.5, 1.0])) for _ in range(60)]
    edges += [("hub", f"n{i}", 1.0) for i in range(12)]
    df = spark.createDataFrame([(a, b, "r", w) for a, b, w in edges], "from STRING, to STRING, relation STRING, weight DOUBLE")
    seeds = spark.createDataFrame([(n, n, 0) for n in (*names, "hub")], "seed STRING, id STRING, position INT")
    got = {}
    for r in graph.expand(df, seeds, 3, 6).orderBy("seed", "position").collect():
        got.setdefault(r["seed"], []).append(r["id"])
    for n in (*names, "hub"):
        assert got.get(n, []) == brute_expand(edges, n, 3, 6), n


def test_callers(spark):
    rows = spark.createDataFrame([
        ("calledby:F", [" defines:A", "imports:x"], ["file:1"]), ("calledby:F", ["defines:A", "defines:B"], ["file:2"]),
        ("calledby:G", ["other"], ["file:3", "file:3"]), ("calls:F", ["defines:Z"], [])],
        "conclusion_id STRING, premise_ids ARRAY<STRING>, supporting_message_ids ARRAY<STRING>")
    got = sorted(map(tuple, codegraph.callers_of_citations(rows).collect()))
    assert got == [("F", "A"), ("F", "B"), ("G", "file:3")]


def test_call_edges_ignore_case(spark):
    source = "func UpdateMessage() {\n\tgetmessagechunks()\n}\nfunc GetMessageChunks() {\n}\n"
    files = spark.createDataFrame([("a.go", source)], "path STRING, source STRING")
    edges = codegraph.call_edges(codegraph.parse(files))
    assert [tuple(r) for r in edges.collect()] == [("UpdateMessage", "GetMessageChunks", "a.go")]


def test_workspaces_of(spark):
    names = ["ws_a", "ws_a_conclusions", "ws_a_reasoning", "ws_b_codeedges", "other", "ws__conclusions", "ws_x_peers"]
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    assert sorted(r[0] for r in predicates.workspaces_of(df).collect()) == ["a", "b_codeedges", "x_peers"]


def test_validation(spark):
    rows = spark.createDataFrame([
        ("w", "s", "user", "x"), ("w", "s", "robot", "x"), ("w", "s", "user", "y" * 100_001), ("", "s", "user", "x"),
        ("w w", "s", "user", "x"), ("w", "", "user", "x")],
        "workspace_id STRING, session_id STRING, role STRING, content STRING").withColumn(
            "metadata", F.lit(None).cast("map<string,string>"))
    got = [r["error"] for r in predicates.validate_messages(rows, 100_000).collect()]
    assert sorted(str(e) for e in got) == sorted([
        "None", "role must be 'user', 'assistant', or 'system'", "content too large", "workspace_id is required",
        "invalid id format", "session_id, role and content are required"])
    assert sum(r["error"] is None for r in predicates.validate_messages(rows).collect()) == 2


def test_inbox(spark):
    t = datetime(2026, 1, 1)
    kind = ("message_id STRING, workspace_id STRING, content STRING, sections MAP<STRING,STRING>, queued_at TIMESTAMP, "
            "status STRING, attempts INT, last_error STRING, applied_at TIMESTAMP")
    rows = lambda items: spark.createDataFrame([
        (m, "w", c, None, t + timedelta(seconds=s), "pending", a, None, None) for m, c, s, a in items], kind)
    inbox = pending.enqueue(rows([("m1", "old", 0, 3)]), rows([("m1", "a", 1, 9), ("m1", "b", 2, 9), ("m2", "", 3, 9), ("m3", "c", 0, 9)]))
    assert sorted((r["message_id"], r["content"], r["attempts"]) for r in inbox.collect()) == [("m1", "b", 0), ("m3", "c", 0)]
    assert [r["message_id"] for r in pending.evict(inbox, 1).collect()] == ["m1"]
    outcome = spark.createDataFrame([("w", "m1", None), ("w", "m3", "down")], "workspace_id STRING, message_id STRING, error STRING")
    after = pending.settle(inbox, outcome, F.lit(t), max_attempts=1)
    assert sorted((r["message_id"], r["status"], r["attempts"]) for r in after.collect()) == [("m1", "applied", 0), ("m3", "failed", 1)]
    assert pending.prune(after, F.lit(t + timedelta(hours=2))).count() == 0


def test_chunk_diff(spark):
    edits = spark.createDataFrame([("m", "a " * 5000, "a " * 100)], "message_id STRING, old STRING, new STRING")
    old, new = chunk_plain(F.col("old")), chunk_plain(F.col("new"))
    got = sorted((r["chunk_index"], r["action"]) for r in dml.chunk_diff(edits, old, new).collect())
    assert got == [(0, "write"), (1, "delete")]
    assert {r["action"] for r in dml.chunk_diff(edits, old, old).collect()} == {"keep"}

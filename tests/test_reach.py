"""Reachability in doubling steps against a plain breadth-first walk."""

from __future__ import annotations

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from recollect.operators import provenance


def plain(links, seeds):
    out = defaultdict(set)
    for a, b in links:
        out[a].add(b)
    found = {}
    for seed, start in seeds:
        queue = deque([(start, 0)])
        while queue:
            node, depth = queue.popleft()
            if found.setdefault((seed, node), depth) < depth or (seed, node, "seen") in found:
                continue
            found[(seed, node, "seen")] = 0
            queue.extend((b, depth + 1) for b in out[node] if (seed, b) not in found)
    return {k: d for k, d in found.items() if len(k) == 2}


def walked(spark, links, seeds, rounds=None):
    hops = spark.createDataFrame(links, "source STRING, target STRING")
    starts = spark.createDataFrame(seeds, "seed STRING, id STRING")
    got = provenance.reached(hops, starts, rounds).collect()
    assert len(got) == len({(r["seed"], r["id"]) for r in got})
    return {(r["seed"], r["id"]): r["depth"] for r in got}


def test_circles_branches_and_odd_links(spark):
    draw = random.Random(3)
    node = lambda: f"n{draw.randint(0, 60)}"
    links = [(node(), node()) for _ in range(70)]
    links += [(f"c{i}", f"c{(i + 1) % 37}") for i in range(37)] + [(f"c{i}", f"d{i}") for i in range(0, 37, 5)]
    links += links[:5] + [("n1", "n1")]
    seeds = [("a", "n1"), ("b", "n2"), ("c", "c0"), ("c", "n3"), ("none", "nowhere"), ("a", "n1")]
    want = plain(links, set(seeds))
    # a seed with two starts keeps the shorter way
    want[("c", "c0")] = want[("c", "n3")] = 0
    assert walked(spark, links + [(None, "n1"), ("n1", None)], seeds) == {
        k: min(d, *[plain(links, [(k[0], s)]).get(k, d) for s in [i for q, i in set(seeds) if q == k[0]]]) for k, d in want.items()}


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    hops = spark.range(n).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    rounds: list[int] = []
    got = provenance.reached(hops, spark.createDataFrame([("s", "0")], "seed STRING, id STRING"), rounds)
    wrong = got.where("CAST(id AS INT) <> depth").count()
    assert (got.count(), wrong) == (n + 1, 0) and len(rounds) <= 15


def test_hubs_stop_the_squaring_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(provenance, "SMALL_SQUARE", 0)
    links = [(f"in{i}", "hub") for i in range(200)] + [("hub", f"out{i}") for i in range(200)]
    links += [(f"out{i}", f"t{i}_0") for i in range(3)] + [(f"t{i}_{j}", f"t{i}_{j + 1}") for i in range(3) for j in range(6)]
    rounds: list[int] = []
    got = walked(spark, links, [("s", "in0"), ("t", "in1")], rounds)
    assert got == plain(links, [("s", "in0"), ("t", "in1")]) and set(rounds) == {1}


def test_no_links_and_no_seeds(spark):
    assert walked(spark, [], [("s", "x")]) == {("s", "x"): 0}
    assert walked(spark, [("x", "y")], []) == {}

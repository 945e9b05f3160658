"""Predicate trees over nested metadata and the depth rule, against plain Python."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from recollect.engine import Memory
from recollect.operators.metadata import matches, nested, too_deep
from recollect.sources.embedding import HashingEmbedder

ROWS = [
    (1, "en", {"n": 5, "who": {"name": "bo", "tags": {"k": 1.5}}, "on": True}),
    (2, "de", {"n": 7.25, "who": {"name": None}, "text": "5"}),
    (3, None, {"n": "five"}),
    (4, "en", {}),
    (5, "fr", None),
]
CASES = [
    ({}, {1, 2, 3, 4, 5}), ({"lang": "en"}, {1, 4}), ({"lang": {"$ne": "en"}}, {2, 3, 5}),
    ({"n": 5}, {1}), ({"n": {"$gte": 5, "$lt": 7}}, {1}), ({"n": {"$gt": 5.0}}, {2}), ({"n": "five"}, {3}),
    ({"who.name": "bo"}, {1}), ({"who.name": {"$ne": "bo"}}, {2, 3, 4, 5}), ({"who.tags.k": {"$lte": 1.5}}, {1}),
    ({"on": True}, {1}), ({"n": {"$in": [5, 7.25, "five"]}}, {1, 2, 3}), ({"n": {"$nin": [5]}}, {2, 3, 4, 5}),
    ({"$or": [{"lang": "de"}, {"n": 5, "on": True}]}, {1, 2}), ({"$and": [{"lang": "en"}, {"on": {"$ne": True}}]}, {4}),
    ({"n": {"$in": []}}, set()), ({"absent": 1}, set()),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, lang, None if m is None else {k: v if isinstance(v, str) else json.dumps(v) for k, v in m.items()})
            for i, lang, m in ROWS]
    return spark.createDataFrame(rows, "id INT, lang STRING, extra MAP<STRING,STRING>")


def test_trees(table):
    flags = [matches(tree, ["id", "lang"], nested(F.col("extra"))).alias(f"c{i}") for i, (tree, _) in enumerate(CASES)]
    rows = table.select("id", *flags).collect()
    for i, (tree, want) in enumerate(CASES):
        assert {r["id"] for r in rows if r[f"c{i}"]} == want, tree
        assert all(r[f"c{i}"] is not None for r in rows), tree


@pytest.mark.parametrize("tree", [{"$not": []}, {"a": {"$like": 1}}, {"$or": []}, {"a..b": 1}])
def test_trees_that_mean_nothing(spark, tree):
    with pytest.raises(ValueError):
        matches(tree, [], F.lit("{}").cast("variant"))


def test_depth(spark):
    deep = lambda n: '{"a":' * n + "1" + "}" * n
    rows = [(n, {"x": "plain {", "m": deep(n)}) for n in range(8)] + [(20, {"m": '{"l": [' + deep(9) + "]}"}), (21, None), (22, {"m": None})]
    got = spark.createDataFrame(rows, "id INT, meta MAP<STRING,STRING>").select("id", too_deep(F.col("meta")).alias("bad")).collect()
    assert {r["id"] for r in got if r["bad"]} == {5, 6, 7}


def test_facade_finds_and_refuses(memory):
    memory.add_message("w", "s", "user", "kept", metadata={"language": "go", "importance": 4}, message_id="a")
    memory.add_message("w", "s", "user", "other", metadata={"language": "py"}, message_id="b")
    found = memory.query_metadata("w", {"$or": [{"language": "go"}, {"importance": {"$gt": 4.5}}]})
    assert [r["message_id"] for r in found.collect()] == ["a"]
    with pytest.raises(ValueError, match="depth"):
        memory.add_message("w", "s", "user", "deep", metadata={"m": {"a": {"b": {"c": {"d": {}}}}}})


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(spark, str(tmp_path / "memory"), HashingEmbedder(16), buckets=2)

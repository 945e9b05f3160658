"""The text index against scans: equal rows, what is read, and changes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recollect.engine import Memory
from recollect.operators.lexical import bm25
from recollect.sources import text_index
from recollect.sources.embedding import HashingEmbedder
from recollect.sources.tables import Tables
from recollect.sources.text_index import TextIndex

SCHEMA = "workspace_id STRING, id STRING, document STRING"
NEEDLES = ["Ent", "the ", "a", "zq", "ünï", "🙂", "one two three", "", "x", "notthere", "İ", "aaa", "b" * 40]


def made(seed, n):
    rng = random.Random(seed)
    words = ["enter", "the", "tent", "Ünïcode", "🙂🙂", "one", "two", "three", "aaaa", "zq", "İstanbul", "B" * 45]
    return [(f"w{rng.randrange(3)}", f"d{k}", " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for k in range(n)] + [
        ("w0", "short", "x"), ("w0", "two", "zQ"), ("w1", "none", None), ("w1", "d1", "the same id elsewhere")]


def pairs(df):
    return sorted((r.workspace_id, r.id) for r in df.collect())


def scanned(df, needle):
    return pairs(df.where(F.contains(F.lower("document"), F.lower(F.lit(needle)))))


@pytest.fixture
def index(spark, tmp_path):
    return TextIndex(Tables(spark, str(tmp_path / "t"), buckets=8))


def first_of(rows):
    return list({(w, i): (w, i, d) for w, i, d in rows}.values())


def test_equals_a_scan(spark, index, monkeypatch):
    df = spark.createDataFrame(first_of(made(1, 80)), SCHEMA)
    index.add(df)
    for most, needles in ((1_000, NEEDLES), (3, ["the ", "a"])):
        monkeypatch.setattr(text_index, "LISTED_KEYS", most)
        for needle in needles:
            assert pairs(index.grep(df, needle)) == scanned(df, needle), needle
    assert pairs(index.grep(df, "the", ["w1"])) == scanned(df.where("workspace_id = 'w1'"), "the")
    # candidates are few: the postings alone rule out most texts
    assert index.candidates(["b" * 40]).count() <= index.grep(df, "b" * 40).count() + 1


def test_bm25_equals_a_scan(spark, index):
    df = spark.createDataFrame(first_of(made(2, 80)), SCHEMA)
    index.add(df)
    for terms in (["the", "ent"], ["zq", "notthere"], ["a"], []):
        whole = df.where("document is not null")
        assert sorted((r.id, round(r.bm25, 9)) for r in index.bm25(df, terms).collect()) == sorted(
            (r.id, round(r.bm25, 9)) for r in bm25(whole, terms).collect())


def test_changes_equal_a_rebuild(spark, index, tmp_path):
    rows = first_of(made(3, 60))
    index.add(spark.createDataFrame(rows, SCHEMA))
    changed = [(w, i, f"{d} tent" if k % 4 == 0 else d) for k, (w, i, d) in enumerate(rows) if k % 5] + [("w2", "new", "enter here")]
    now = spark.createDataFrame(changed, SCHEMA)
    index.sync(now)
    fresh = TextIndex(Tables(spark, str(tmp_path / "fresh"), buckets=8))
    fresh.add(now)
    for _ in range(2):
        for needle in ("tent", "the", "zq", "x", ""):
            assert pairs(index.candidates([needle])) == pairs(fresh.candidates([needle]))
            assert pairs(index.grep(now, needle)) == scanned(now, needle)
        index.compact()
    assert index.tables.read("text_grams").count() == fresh.tables.read("text_grams").count()
    index.remove(now.where("id = 'new'"))
    assert ("w2", "new") not in pairs(index.candidates(["enter"]))


def test_reads_only_buckets_and_candidates(spark, index, tmp_path):
    df = spark.createDataFrame(first_of(made(4, 60)), SCHEMA)
    index.add(df)
    df.write.partitionBy("workspace_id").parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    grams_plan = index.tables.having("text_grams", ["ent"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in grams_plan and "bucket" in grams_plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "EqualTo(gram,ent)" in grams_plan or "In(gram" in grams_plan
    found = index.grep(stored, "notthere")
    assert "LocalTableScan <empty>" in found._jdf.queryExecution().executedPlan().toString() or found.count() == 0
    plan = index.grep(stored, "b" * 40)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "In(id" in plan.replace("EqualTo(id", "In(id")


def test_facade_keeps_the_index(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "store"), HashingEmbedder(16), buckets=2, index_texts=True)
    memory.add_message("wa", "s", "user", "Green tea at noon", message_id="x1")
    memory.add_message("wa", "s", "user", "Black coffee", message_id="x2")
    grep = lambda needle: sorted(r.message_id for r in memory.grep(needle, "wa").collect())
    assert grep("TEA") == ["x1"] and grep("e") == ["x1", "x2"]
    memory.update_message("wa", "x1", content="Water now")
    assert grep("tea") == [] and grep("water") == ["x1"]
    memory.delete_message("wa", "x2")
    assert grep("coffee") == []
    assert memory.tables.read("text_docs").count() == 1

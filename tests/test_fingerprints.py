"""Set equality: every kind of small difference is found and named, equal tables have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators.fingerprints import differences

SCHEMA = "w STRING, id STRING, text STRING, at TIMESTAMP, x DOUBLE, tags ARRAY<STRING>, extra MAP<STRING,STRING>"


def test_every_difference_is_named(spark):
    from datetime import datetime as t

    noon = t(2026, 1, 1, 12, 0, 0, 5)
    rows = [("w", f"r{i}", f"text {i}", noon, i / 7, ["a", None, "b"], {"k": "v", "l": "m"}) for i in range(40)] + [
        ("w", None, None, None, None, None, None), (None, "r1", "", noon, 0.0, [], {}), ("w", "twice", "same", noon, 1.0, [], {})]
    live = spark.createDataFrame(rows, SCHEMA)
    turned = [(w, i, a, b, c, d, dict(reversed(e.items())) if e else e) for w, i, a, b, c, d, e in reversed(rows)]
    assert differences(live, spark.createDataFrame(turned, SCHEMA).repartition(3), ["w", "id"]).count() == 0

    copy = list(rows)
    change = lambda i, place, value: copy.__setitem__(i, (*copy[i][:place], value, *copy[i][place + 1:]))
    change(1, 2, "text 1.")
    change(2, 3, noon.replace(microsecond=6))
    change(3, 4, 3 / 7 + 1e-16)
    change(4, 5, [None, "a", "b"])
    change(5, 6, {"k": "m", "l": "v"})
    change(6, 2, None)
    change(41, 2, None)
    copy[7:8] = []
    copy += [("w", "new", "n", noon, 1.0, [], {}), rows[-1]]
    got = {(r.w, r.id): (r.status, r.live_rows, r.restored_rows) for r in differences(live, spark.createDataFrame(copy, SCHEMA), ["w", "id"], 8).collect()}
    changed = {("w", f"r{i}"): ("changed", 1, 1) for i in (1, 2, 3, 4, 5, 6)}
    assert got == changed | {(None, "r1"): ("changed", 1, 1), ("w", "r7"): ("missing", 1, 0), ("w", "new"): ("extra", 0, 1), ("w", "twice"): ("changed", 1, 2)}


def test_empty_and_lacking_columns(spark):
    live = spark.createDataFrame([("w", "a", 1)], "w STRING, id STRING, n INT")
    none = live.limit(0)
    assert differences(none, none, ["w", "id"]).count() == 0
    assert [r.status for r in differences(live, none, ["w", "id"]).collect()] == ["missing"]
    assert [r.status for r in differences(live, live.drop("n"), ["w", "id"]).collect()] == ["changed"]
    assert differences(live.withColumn("n", F.lit(None).cast("int")), live.withColumn("n", F.lit(None).cast("int")), ["w", "id"]).count() == 0

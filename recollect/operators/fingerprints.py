"""Are two tables equal as sets of rows, and if not, where do they differ?

The rows of a range of keys are summed up as order-free fingerprints: their number and the sums of two 64-bit hashes of each row (in halves of 32 bits,
so that no sum overflows). Equal tables cost one scan of each side and a row for each range; rows are compared only in ranges that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.skew import join_lookup
from recollect.session import cut_lineage

RANGES = 1024
_SUMS = ["rows", "s0", "s1", "s2", "s3"]


def _row_hashes(rows: DataFrame, columns: list[str]) -> list[Column]:
    """Two hashes of a row in four halves. Values are hashed as they are, so no digit of a time or number is lost; whether each is null is hashed
    beside it, as a hash passes over nulls, and for nulls inside arrays and structs their JSON is."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c), F.col(c).isNull()]
        if rows.schema[c].dataType.typeName() in ("array", "struct"):
            parts.append(F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}))
    first, second = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))
    low = F.lit((1 << 32) - 1)
    return [h for x in (first, second) for h in (x.bitwiseAND(low), F.shiftrightunsigned(x, 32))]


def _comparable(rows: DataFrame) -> DataFrame:
    maps = [f.name for f in rows.schema.fields if f.dataType.typeName() == "map"]
    return rows.withColumns({m: F.array_sort(F.map_entries(m)) for m in maps}) if maps else rows


def fingerprints(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A row for each value of `by` (null is one): number of rows and sums of their hashes, added up map-side."""
    rows = _comparable(rows)
    hashed = rows.select(*by, *[h.alias(f"s{i}") for i, h in enumerate(_row_hashes(rows, columns))])
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)])


def _unequal(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The values of `by` whose fingerprints differ, with the number of rows of each side."""
    left = a.select(*by, *[F.col(c).alias(f"a_{c}") for c in _SUMS])
    right = b.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(c).alias(f"b_{c}") for c in _SUMS])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    differ = reduce(lambda x, y: x | y, [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in _SUMS])
    return left.join(right, same, "full_outer").where(differ).select(
        *[F.coalesce(c, f"_{c}").alias(c) for c in by], F.coalesce("a_rows", F.lit(0)).alias("live_rows"), F.coalesce("b_rows", F.lit(0)).alias("restored_rows"))


def differences(live: DataFrame, restored: DataFrame, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """keys, live_rows, restored_rows and status (missing, extra, changed) of every key under which the rows differ as a multiset. Columns that
    one side lacks are a difference of every row; an empty result means equality."""
    columns = sorted(set(live.columns) | set(restored.columns))
    sides = []
    for rows in (live, restored):
        lacking = {c: F.lit("\x00no such column") for c in columns if c not in rows.columns}
        sides.append(rows.withColumns(lacking).withColumn("_range", F.pmod(F.xxhash64(*keys), F.lit(ranges))))
    spots = cut_lineage(_unequal(*(fingerprints(s, ["_range"], columns) for s in sides), ["_range"]).select("_range"))
    if spots.isEmpty():
        found = live.select(*keys, F.lit(0).cast("long").alias("live_rows"), F.lit(0).cast("long").alias("restored_rows")).limit(0)
    else:
        near = [fingerprints(join_lookup(s, spots, ["_range"], "left_semi"), keys, columns) for s in sides]
        found = _unequal(*near, keys)
    return found.withColumn("status", F.when(F.col("restored_rows") == 0, "missing").when(F.col("live_rows") == 0, "extra").otherwise("changed"))

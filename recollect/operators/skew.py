"""Joins, ranks and running sums that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import cut_and_free, cut_lineage, hold

# Compressed columns of this size are at most a few hundred megabytes as a hash table.
BROADCAST_BYTES = 16 << 20


def written_bytes(table: DataFrame) -> int:
    """The size of a table read from files, as they lie there."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _is_written(table: DataFrame) -> bool:
    return table._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LogicalRelation"


def join_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "left",
                max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join to a lookup table with one row per key.

    The lookup is written first, and the size of its files decides: within `max_bytes` it is broadcast
    and `rows` are not shuffled. Beyond it both sides are shuffled once, on the key; the partitions that
    hot keys fill are found while the join runs and split over several tasks (adaptive skew join), so that
    nothing is repeated for keys that are not hot. A lookup that is a written table already is not written again.
    """
    lookup = lookup if _is_written(lookup) else cut_lineage(lookup)
    small = written_bytes(lookup) <= max_bytes
    return rows.join(F.broadcast(lookup) if small else lookup.hint("merge"), on, how)


# Bits of a sieve: 32 MB as a broadcast table, whatever the number of keys; a thousand words of it are a row.
SIEVE_BITS = 1 << 28
SIEVE_ROW = 1 << 16


def sifted(rows: DataFrame, lookup: DataFrame, on: list[str], max_bytes: int | None = None, bits: int = SIEVE_BITS) -> DataFrame:
    """`rows` without those, or without most of those, whose key a written lookup table does not have, unshuffled.

    Keys within `max_bytes` are broadcast themselves, and none but their rows stay. Of more keys a bit of each one's hash is
    broadcast: about sixteen bits a key, up to `bits`. All rows with a key of the lookup stay, and those of others whose
    hash meets the bit of one; they leave in the join.
    """
    if written_bytes(lookup) <= (BROADCAST_BYTES if max_bytes is None else max_bytes):
        return rows.join(F.broadcast(lookup.select(*on)), on, "left_semi")
    size = min(max(1 << (16 * lookup.count()).bit_length(), SIEVE_ROW), bits)
    spot = F.xxhash64(*on).bitwiseAND(F.lit(size - 1))
    words = lookup.select(spot.alias("_spot")).selectExpr("shiftright(_spot, 6) AS _word", "shiftleft(1L, CAST(_spot & 63 AS INT)) AS _bits")
    # a row of zeros for each word, so that a word's place in the row is its number
    zeros = rows.sparkSession.range(size // 64).selectExpr("id AS _word", "0L AS _bits")
    filled = words.unionByName(zeros).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    sieve = cut_and_free(filled.groupBy(F.shiftright("_word", 10).alias("_row")).agg(
        F.sort_array(F.collect_list(F.struct("_word", "_bits")))["_bits"].alias("_words")))
    word = F.get("_words", F.shiftright(spot, 6).bitwiseAND(F.lit(1023)).cast("int"))
    met = F.call_function("shiftright", word, spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(sieve), (F.shiftright(spot, 16) == F.col("_row")) & met, "left_semi")


def absent(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not stored. The stored keys are reduced to the ones in question
    first, so that a small batch is broadcast to a large table instead of the table being
    shuffled."""
    known = stored.select(*keys).join(rows.select(*keys), keys, "left_semi")
    return rows.join(known, keys, "left_anti")


def running(rows: DataFrame, keys: list[str], order: list[Column], value: Column | None = None,
            rank: str = "rn", total: str = "running") -> DataFrame:
    """Row numbers (and running sums of `value`) per key, in `order`, without ever bringing a
    whole key into one task.

    Rows are range-partitioned on key and order, which splits a hot key over many tasks, and
    written once so that the split is the same wherever it is read. Each (key, task) is summed
    up, the sums give every task its offset, and a window inside the task does the rest.
    `order` has to tell all rows of a key apart.
    """
    value = F.lit(0) if value is None else value
    split = cut_lineage(
        rows.withColumn("_v", value)
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id()))
    counts = split.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"))
    # one row per key and task: small, and bounded by the number of tasks for each key
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        split.join(offsets, [*keys, "_part"])
        .withColumn(rank, F.row_number().over(inside) + F.col("_n0"))
        .withColumn(total, F.sum("_v").over(so_far) + F.col("_s0"))
        .drop("_part", "_v", "_n0", "_s0"))


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int,
                rank: str = "rank") -> DataFrame:
    """The first `k` rows of each key with their zero-based rank (E1). Spark limits every task
    to `k` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .withColumn(rank, F.col("_rn") - 1).drop("_rn"))


def top_rows(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first `k` rows, computed once. That keeps the sort right under its limit: Spark then
    lets every task keep `k` rows only, where a projection pushed in between would make it sort
    the whole table."""
    return hold(rows.orderBy(*order).limit(k), k)


def rank_bounded(rows: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows overall with their zero-based rank: a distributed top-k, then one
    window over at most `k` rows."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return top_rows(rows, order, k).withColumn(rank, F.row_number().over(w) - 1)


def first_seen(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by a partial aggregate (no sort, no whole key in a task)."""
    body = [c for c in rows.columns if c not in keys]
    packed = F.min_by(F.struct(*body), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(packed).select(*keys, "_row.*")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0,
         shallow: int = 10_000) -> DataFrame:
    """F8: a page in a fixed order. Pages near the start use a distributed top-k; deep ones a
    distributed rank, so that no task sorts everything before the page."""
    if offset + limit <= shallow:
        return rows.orderBy(*order).limit(offset + limit).offset(offset)
    numbered = running(rows, [], order, rank="_rn", total="_unused").drop("_unused")
    return numbered.where(F.col("_rn").between(offset + 1, offset + limit)).drop("_rn")

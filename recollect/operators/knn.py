"""Filtered nearest neighbours by cosine distance, exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.vectors import cosine_distance
from recollect.operators.skew import join_lookup, rank_bounded
from recollect.session import cut_lineage, small_batches


def with_distance(rows: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """Adds `distance` and drops the vector column at once, so that no later step carries it.
    Rows without a vector of the query's width are left out."""
    stored = "norm" if "norm" in rows.columns else None
    return (rows.where(F.size(vector) == len(query))
            .withColumn("distance", cosine_distance(vector, query, stored)).drop(vector, "norm"))


def nearest(rows: DataFrame, query: list[float], k: int, where: Column | None = None,
            id_: str = "id", vector: str = "embedding") -> DataFrame:
    """The `k` nearest rows and their zero-based `rank`, ties by id. The filter reaches the
    scan; every task keeps its own `k` best, so only those are shuffled."""
    rows = rows if where is None else rows.where(where)
    return rank_bounded(with_distance(rows, query, vector),
                        [F.col("distance"), F.col(id_)], k)


def near_any(queries: DataFrame, rows: DataFrame, keys: list[str], distance: float, group: str = "workspace_id",
             vector: str = "embedding", block: int = 512) -> DataFrame:
    """The `keys` of queries that have a row of their group nearer than `distance`, exact.

    Both sides are packed into blocks of about `block` vectors of a group; each pair of blocks of a group is
    compared as two matrices inside one task, which gives the keys of near queries and no pairs. A large
    group has many blocks, so it is spread over many tasks. Rows whose vector has another width than
    the query's can't be compared; they are counted by `other_widths`.
    """
    small_batches(rows.sparkSession)  # a row is two blocks
    asked = _packed(queries, group, block, vector, F.struct(*keys)).select(group, F.col("items").alias("asked"))
    known = _packed(rows, group, block, vector, F.lit(0)).select(group, F.col("items").alias("known"))
    kinds = ", ".join(f"`{k}` {queries.schema[k].dataType.simpleString()}" for k in keys)

    def compare(batches):
        for asked_at, stored in _pairs(batches):
            for width, (places, own) in asked_at.widths().items():
                others = stored.widths().get(width)
                if others:
                    near = (unit_rows(own) @ unit_rows(others[1]).T > 1 - distance).any(axis=1)
                    yield asked_at.keys(places[near], keys)

    return asked.join(known, group).select("asked", "known").mapInArrow(compare, kinds).distinct()


def in_parts(queries: DataFrame, rows: DataFrame, parts: int = 16) -> tuple[DataFrame, DataFrame]:
    """Queries that are to meet all rows, for `top_matches` by `part`: rows are spread over the parts by their id, and every query
    stands in each of them, so that they are joined by a key."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    return queries.withColumn("part", numbers), rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))


def top_matches(queries: DataFrame, rows: DataFrame, keys: list[str], k: int, group: str = "workspace_id",
                vector: str = "embedding", block: int = 512) -> DataFrame:
    """keys, id, distance: the `k` nearest rows (`id`) of each query among the rows of its group, ties by id, exact. A query may stand in
    several groups; its best rows of all of them are found. Vectors with components that are no numbers match nothing.

    Blocks of queries meet blocks of rows as in `near_any`; each pair of blocks hands on at most `k` rows for each query, and the
    best of those are kept by a partial aggregate. No pairs of rows leave a task.
    """
    small_batches(rows.sparkSession)  # a row is two blocks
    asked = _packed(queries, group, block, vector, F.struct(*keys)).select(group, F.col("items").alias("asked"))
    known = _packed(rows, group, block, vector, F.struct("id")).select(group, F.col("items").alias("known"))
    id_kind = rows.schema["id"].dataType
    kinds = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in keys)

    def compare(batches):
        for asked_at, stored in _pairs(batches):
            ids = stored.key.field("id")
            for width, (places, own) in asked_at.widths().items():
                others = stored.widths().get(width)
                if not others:
                    continue
                far = 1 - unit_rows(own) @ unit_rows(others[1]).T
                n = min(k, len(others[0]))
                last = np.partition(far, n - 1, axis=1)[:, n - 1]
                q, j = np.nonzero(far <= last[:, None])
                counts = np.bincount(q, minlength=len(far))
                kept = counts[q] <= k
                for i in np.flatnonzero(counts > k):  # ties go by id
                    line = np.flatnonzero(q == i)
                    names = [_plain(x) for x in ids.take(pa.array(others[0][j[line]])).to_pylist()]
                    kept[line[sorted(range(len(line)), key=lambda x: (far[i, j[line[x]]], names[x]))[:k]]] = True  # noqa: B023
                q, j = q[kept], j[kept]
                told = asked_at.keys(places[q], keys)
                yield pa.RecordBatch.from_arrays([*told.columns, ids.take(pa.array(others[0][j])), pa.array(far[q, j])],
                                                 names=[*keys, "id", "distance"])

    pairs = asked.join(known, group).select("asked", "known").mapInArrow(compare, f"{kinds}, id {id_kind.simpleString()}, distance double")
    # at most k rows for each query and pair of blocks
    split = pairs.groupBy(*keys, F.pmod(F.xxhash64("id"), F.lit(16)).alias("_s")).agg(_first(k))
    return (split.select(*keys, F.explode("h").alias("h")).select(*keys, "h.*").groupBy(*keys).agg(_first(k))
            .select(*keys, F.explode("h").alias("h")).select(*keys, "h.id", "h.distance"))


class _Block:
    """The items of a block as they stand in the Arrow batch: no Python object for a vector or a key."""

    def __init__(self, items: pa.StructArray):
        self.key, self.vectors = items.field("key"), items.field("v")

    def widths(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and vectors (a matrix) of the items of each width whose components are numbers."""
        sizes = pc.list_value_length(self.vectors).to_numpy(zero_copy_only=False)
        out = {}
        for width in np.unique(sizes).tolist():
            places = np.flatnonzero(sizes == width)
            m = self.vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            sound = np.isfinite(m).all(axis=1)
            if sound.any():
                out[width] = places[sound], m[sound]
        return out

    def keys(self, places: np.ndarray, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.key.field(n).take(pa.array(places)) for n in names], names=names)


def _pairs(batches):
    """The two blocks of each row, one row at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(_Block(batch.column(c)[i].values) for c in ("asked", "known"))


def _first(k: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(F.struct("distance", "id"))), 1, k).alias("h")


def _plain(value):
    return tuple(value.values()) if isinstance(value, dict) else value


def _packed(rows: DataFrame, group: str, block: int, vector: str, key: Column) -> DataFrame:
    """Blocks of about `block` vectors of a group; a row's block follows from its content."""
    held = rows.where(F.size(vector) > 0)
    sizes = cut_lineage(held.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks")))
    placed = join_lookup(held.select(group, key.alias("key"), F.col(vector).cast("array<double>").alias("v")), sizes, [group], "inner")
    return placed.groupBy(group, F.pmod(F.xxhash64("key", "v"), F.col("_blocks")).alias("_b")).agg(
        F.collect_list(F.struct("key", "v")).alias("items"))


def other_widths(rows: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """How many rows a search by vectors of `width` can't see: those of another width and those without a vector."""
    return rows.agg(F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != width).alias("unseen"))


def unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

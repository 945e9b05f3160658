"""An inverted-file index of vectors, kept as a table.

Centres are fitted by k-means (cosine) on a sample of at most about `SAMPLE_BYTES`, taken by the hash of the row's key; every row is
assigned to its nearest centre and lies in the folder of that list. A search scores the rows of the lists nearest to the query, so only
those folders are read. How many lists that takes for the wished recall is measured when the index is built, against exact results.

An exact search goes on after that: a list can hold a nearer row only if the angle between query and centre, less the largest angle of the list's rows,
leaves room. Those lists, and no others, are read as well; if the filter left fewer than k rows, that is all of them.

Folders below `path`: `centres` (list, centre), `reach` (list, largest angle; appended by each write), `lists` (rows by list), `columns` (no rows: their schema), `probes`. Rows that have
no direction or another width than the centres are in list -1, which every search reads.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.operators.knn import in_parts, nearest, top_matches, unit_rows
from recollect.operators.skew import join_lookup, top_rows
from recollect.session import cut_and_count, cut_lineage

SAMPLE_BYTES = 64 << 20
MAX_LISTS = 4096  # centres are broadcast: at most a few dozen megabytes
CALIBRATION_ROWS = 200
RECALL = 0.95
KEY = ["workspace_id", "id"]
LOOSE = -1
SLACK = 1e-7
CELLS = 1 << 20  # rows times lists that a task compares at once


def _units(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction and the width, and those as unit vectors."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False).copy()
    m = vectors.take(pa.array(np.flatnonzero(fits))).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    sound = np.isfinite(m).all(axis=1) & m.any(axis=1)
    fits[np.flatnonzero(fits)[~sound]] = False
    return fits, unit_rows(m[sound])


def _slices(batches, lists: int):
    """The batches in pieces whose rows make about `CELLS` numbers with the lists."""
    rows = max(1, CELLS // max(1, lists))
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str

    # -- building ----------------------------------------------------------------------------
    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int | None = None, recall: float = RECALL, k: int = 10) -> VectorIndex:
        """An index of `rows` (workspace_id, id, embedding and columns to filter by) at a new `path`. `lists` is about the root
        of the number of rows unless given; the number of lists that a search reads is set to reach `recall` at `k`."""
        index = cls(rows.sparkSession, path.rstrip("/"))
        common = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
        width, n = (common["width"], common["count"]) if common else (1, 0)
        lists = lists or min(MAX_LISTS, max(1, round(n ** 0.5)))
        centres = index._fit(rows.where(F.size("embedding") == width), width, n, lists)
        index.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list INT, centre ARRAY<DOUBLE>").coalesce(1).write.parquet(
            f"{index.path}/centres")
        rows.limit(0).withColumn("mark", F.lit(0).cast("long")).coalesce(1).write.parquet(f"{index.path}/columns")
        index.add(rows)
        index.calibrate(recall, k)
        return index

    def _fit(self, rows: DataFrame, width: int, n: int, lists: int) -> np.ndarray:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if n <= lists or lists == 1:
            lists = 1
        every = max(1, -(-n * width * 8 // SAMPLE_BYTES))
        sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
        sample, held = cut_and_count(rows.where(sound & (F.pmod(F.xxhash64(*KEY), F.lit(every)) == 0))
                                     .select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
        if not held:
            return np.eye(1, width)
        fitted = KMeans(k=min(lists, held), distanceMeasure="cosine", seed=7, maxIter=12, initSteps=2).fit(sample)
        return unit_rows(np.array(fitted.clusterCenters()))

    def _assigned(self, rows: DataFrame) -> DataFrame:
        """The rows with the list and the angle to its centre."""
        held, width = self.spark.sparkContext.broadcast(self.centres), self.centres.shape[1]
        columns = rows.columns

        def run(batches):
            for batch in _slices(batches, len(held.value)):
                fits, m = _units(batch.column("embedding"), width)
                which, angle = np.full(len(fits), LOOSE, np.int32), np.zeros(len(fits))
                cosine = m @ held.value.T
                which[fits] = cosine.argmax(axis=1) if len(m) else 0
                angle[fits] = np.arccos(np.clip(cosine.max(axis=1), -1, 1)) if len(m) else 0
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(which), pa.array(angle)], names=[*columns, "list", "angle"])

        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
        return rows.select(*columns).mapInArrow(run, f"{kinds}, list int, angle double")

    def add(self, rows: DataFrame) -> None:
        """Rows under new keys: each goes to the folder of its list. Large lists become several files."""
        mark = F.xxhash64(*[c for c in rows.columns if c not in KEY and c != "mark"])
        placed = cut_lineage(self._assigned(rows.withColumn("mark", mark)))
        placed.groupBy("list").agg(F.max("angle").alias("reach")).coalesce(1).write.mode("append").parquet(f"{self.path}/reach")
        placed.drop("angle").hint("rebalance", "list").write.partitionBy("list").mode("append").parquet(f"{self.path}/lists")

    def refresh(self, rows: DataFrame) -> None:
        """The index of `rows`, from the index as it is: only rows that are new, changed or gone are touched, in their lists. The centres
        stay; build anew when the data have changed a lot."""
        mark = F.xxhash64(*[c for c in rows.columns if c not in KEY])
        now = rows.select(*KEY, mark.alias("mark"))
        stored = self.rows().select(*KEY, "mark", "list")
        gone = cut_lineage(stored.join(now, [*KEY, "mark"], "left_anti"))
        fresh = cut_lineage(now.join(stored.select(*KEY, "mark"), [*KEY, "mark"], "left_anti"))
        self._drop(gone)
        if not fresh.isEmpty():
            self.add(join_lookup(rows, fresh.select(*KEY), KEY, "left_semi"))

    def _drop(self, gone: DataFrame) -> None:
        """Rewrites the lists that rows leave, through a staging folder."""
        touched = [r["list"] for r in gone.select("list").distinct().collect()]  # at most MAX_LISTS + 1
        if not touched:
            return
        staging = f"{self.path}/_staging/{uuid.uuid4().hex}"
        self.rows().where(F.col("list").isin(touched)).join(gone.select(*KEY, "mark"), [*KEY, "mark"], "left_anti").write.parquet(staging)
        left = self.spark.read.parquet(staging)
        left.hint("rebalance", "list").write.partitionBy("list").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/lists")
        jvm = self.spark.sparkContext._jvm
        kept = {r["list"] for r in left.select("list").distinct().collect()}
        for folder in [f"{self.path}/lists/list={i}" for i in touched if i not in kept] + [staging]:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    # -- reading -----------------------------------------------------------------------------
    def rows(self) -> DataFrame:
        kept = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(kept.add("list", T.IntegerType())).parquet(f"{self.path}/lists")

    @cached_property
    def centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()
        return np.array([r["centre"] for r in found])

    def _reach(self) -> np.ndarray:
        """The largest angle between a centre and a row of its list."""
        out = np.zeros(len(self.centres))
        for r in self.spark.read.parquet(f"{self.path}/reach").groupBy("list").agg(F.max("reach").alias("reach")).collect():
            if r["list"] != LOOSE:
                out[r["list"]] = r["reach"]
        return out

    @property
    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.path}/probes").orderBy(F.desc("set_at")).first()["probes"]

    def calibrate(self, recall: float = RECALL, k: int = 10) -> int:
        """Sets how many lists a search reads: enough for `recall` of the true neighbours of about `CALIBRATION_ROWS` rows."""
        own = self.rows().where(F.col("list") != LOOSE).select(*KEY, "list", "embedding")
        n = own.count()
        some = own.where(F.pmod(F.xxhash64("id", *KEY), F.lit(max(1, n // CALIBRATION_ROWS))) == 0).orderBy(F.xxhash64(*KEY)).limit(2 * CALIBRATION_ROWS)
        asked = cut_lineage(some.select(F.concat_ws("/", *KEY).alias("q"), "embedding"))
        every, parts = in_parts(asked, own.select("id", "list", "embedding"))
        true = top_matches(every, parts.select(F.col("list").alias("id"), "embedding", "part"), ["q"], k, "part")
        order = self._orders(asked)
        place = true.join(order, "q").select(F.expr("array_position(lists, id)").alias("place"))
        needed = place.agg(F.percentile("place", F.lit(recall)).alias("p")).first()["p"]
        probes = int(np.ceil(needed)) if needed else 1
        self.spark.range(1).select(F.lit(probes).alias("probes"), F.current_timestamp().alias("set_at")).write.mode("append").parquet(f"{self.path}/probes")
        return probes

    def _orders(self, queries: DataFrame) -> DataFrame:
        """q, the lists from the nearest on, and for each the least distance that one of its rows can have."""
        centres = self.centres
        held = self.spark.sparkContext.broadcast((centres, self._reach()))

        def run(batches):
            c, reach = held.value
            for batch in _slices(batches, len(c)):
                fits, m = _units(batch.column("embedding"), c.shape[1])
                angle = np.arccos(np.clip(m @ c.T, -1, 1))
                order = np.argsort(angle, axis=1, kind="stable")
                least = np.take_along_axis(1 - np.cos(np.maximum(angle - reach, 0)), order, axis=1) - SLACK
                yield pa.RecordBatch.from_arrays(
                    [batch.column("q").filter(pa.array(fits)), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(least), pa.list_(pa.float64()))],
                    names=["q", "lists", "least"])

        return queries.select("q", "embedding").mapInArrow(run, f"q {queries.schema['q'].dataType.simpleString()}, lists array<int>, least array<double>")

    def search(self, vector: list[float], k: int, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """The k nearest rows with `distance` and zero-based `rank`; only the folders of the probed lists are read."""
        q = np.asarray(vector, np.float64)
        rows = self.rows().drop("mark")
        if len(q) != self.centres.shape[1] or not q.any():
            return nearest(rows, vector, k, where).drop("list")  # the centres say nothing about it
        angle = np.arccos(np.clip(self.centres @ (q / np.sqrt(q @ q)), -1, 1))
        order = np.argsort(angle, kind="stable")
        first = order[:probes or self.probes].tolist()
        hits = nearest(rows.where(F.col("list").isin([LOOSE, *first])), vector, k, where)
        if exact:
            far = hits.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).first()
            least = 1 - np.cos(np.maximum(angle - self._reach(), 0)) - SLACK
            rest = [i for i in order[len(first):].tolist() if far["n"] < k or not least[i] > far["d"]]
            if rest:
                more = nearest(rows.where(F.col("list").isin(rest)), vector, k, where)
                hits = _ranked(hits.drop("rank").unionByName(more.drop("rank")), k)
        return hits.drop("list")

    def search_many(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """q, workspace_id, id, distance: the k nearest rows of every query (q, embedding). Queries and rows of a list meet in blocks; each
        block hands on k rows for each query. Queries without a direction or of another width have no rows."""
        queries = cut_lineage(queries.select("q", "embedding"))
        order = cut_lineage(self._orders(queries))
        rows = self.rows() if where is None else self.rows().where(where)
        rows = rows.select(F.struct(*KEY).alias("id"), "embedding", "list")
        first = order.select("q", F.explode(F.concat(F.array(F.lit(LOOSE)), F.slice("lists", 1, probes or self.probes))).alias("list"))
        hits = cut_lineage(self._asked(queries, first, rows, k))
        if exact:
            far = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
            rest = order.join(far, "q", "left").select("q", "n", "far", F.explode(F.arrays_zip("lists", "least")).alias("z")).where(
                (F.coalesce("n", F.lit(0)) < k) | (F.col("z.least") <= F.col("far"))).select("q", F.col("z.lists").alias("list"))
            rest = rest.join(first, ["q", "list"], "left_anti")
            both = hits.unionByName(self._asked(queries, rest, rows, k))
            hits = both.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "id"))), 1, k).alias("h")).select(
                "q", F.explode("h").alias("h")).select("q", "h.id", "h.distance")  # at most 2 k rows for each query
        return hits.select("q", "id.*", "distance")

    def _asked(self, queries: DataFrame, pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        return top_matches(pairs.join(queries, "q"), rows, ["q"], k, "list")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    top = top_rows(hits, [F.col("distance"), F.col("id")], k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("distance", "id")) - 1)

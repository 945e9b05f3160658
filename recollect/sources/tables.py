"""The engine's tables as Parquet folders.

Rows lie under workspace and key bucket. New keys are appended. A change to stored keys rewrites
only the partitions these are in: their new content is written to a staging folder first and then
replaces them, so that no plan reads what it overwrites and a broken run can be repeated. Files
are balanced by size as they are written, so a workspace that holds a large share of all rows
is spread over many tasks and files.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect import schema
from recollect.operators import dml
from recollect.session import cut_and_count, cut_lineage

PARTITIONS = ["workspace_id", "bucket"]


class Tables:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # -- files -------------------------------------------------------------------------------
    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        """A2."""
        fs, p = self._fs(self.path(name))
        return fs.exists(p)

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # -- reading -----------------------------------------------------------------------------
    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(schema.TABLES[name])

    def read(self, name: str) -> DataFrame:
        """The table, or no rows where nothing was written. Filters on the workspace prune
        folders, columns and other filters reach the Parquet scan."""
        wanted = self.schema(name)
        if not self.exists(name):
            return self.spark.createDataFrame([], wanted)
        stored = T.StructType(wanted.fields + [T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(stored).parquet(self.path(name)).select(*wanted.names)

    def having(self, name: str, values: list[str]) -> DataFrame:
        """The rows whose last key column is one of the values: their buckets are folders, so no others are read."""
        stored = self._stored(name)
        buckets = [F.pmod(F.xxhash64(F.lit(v)), F.lit(self.buckets)).cast("int") for v in values]
        own = F.col(schema.KEYS[name][-1]).isin(values)
        return stored.where(F.col("bucket").isin(buckets) & own).drop("bucket") if values else stored.limit(0).drop("bucket")

    def _placed(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows in the table's columns with their bucket; without a key any bucket will do."""
        keys = schema.KEYS.get(name)
        own = "message_id" if name == "chunks" else keys[-1] if keys else None
        wanted = self.schema(name)
        at = F.xxhash64(own) if own else F.xxhash64(*wanted.names)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns
                   else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields]
        if "workspace_id" not in wanted.names:
            columns.append(F.coalesce("workspace", F.lit("")).alias("workspace_id"))
        return rows.select(*columns).withColumn("bucket", F.pmod(at, F.lit(self.buckets)).cast("int"))

    # -- writing -----------------------------------------------------------------------------
    def append(self, name: str, rows: DataFrame) -> None:
        """A5."""
        self._append(name, self._placed(name, rows))

    def _append(self, name: str, placed: DataFrame) -> None:
        placed.hint("rebalance", *PARTITIONS).write.partitionBy(*PARTITIONS).mode("append").parquet(self.path(name))

    def merge(self, name: str, rows: DataFrame) -> None:
        """Insert or replace by key. Which keys are stored is read from the key columns of
        the partitions in question; a batch of new keys, the usual case, is appended and rewrites
        nothing."""
        keys = schema.KEYS[name]
        placed, count = cut_and_count(self._placed(name, rows))
        if not count:
            return
        touched = placed.select(*PARTITIONS).distinct()
        held = self._within(self._stored(name), touched).select(*dict.fromkeys([*keys, *PARTITIONS]))
        hit, hits = cut_and_count(held.join(placed.select(*dict.fromkeys([*keys, *PARTITIONS])),
                                            list(dict.fromkeys([*keys, *PARTITIONS])), "left_semi")
                                  .select(*PARTITIONS).distinct())
        if not hits:
            return self._append(name, placed)
        self._append(name, placed.join(hit, PARTITIONS, "left_anti"))
        again = placed.join(hit, PARTITIONS, "left_semi")
        self._replace(name, hit, lambda stored: dml.upsert(stored, again, keys))

    def compact(self, name: str) -> None:
        """Rewrites the partitions so that many small files become few."""
        self._replace(name, self._stored(name).select(*PARTITIONS).distinct(), lambda stored: stored)

    def delete(self, name: str, gone: DataFrame) -> None:
        """A10: delete the given rows (their keys, workspace and what the bucket is made of).
        Their partitions follow from them, so no others are read."""
        on = schema.KEYS[name]
        placed, count = cut_and_count(self._placed(name, gone).select(*dict.fromkeys([*on, *PARTITIONS])))
        if count:
            self._replace(name, placed.select(*PARTITIONS).distinct(),
                          lambda rows: dml.delete(rows, placed, on))

    def delete_where(self, name: str, condition) -> None:
        """A11."""
        self._replace(name, self._stored(name).where(condition).select(*PARTITIONS).distinct(),
                      lambda rows: dml.delete_where(rows, condition))

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace the whole table."""
        placed = cut_lineage(self._placed(name, rows))
        self._remove(self.path(name))
        self._write(name, placed)

    def drop_workspace(self, workspace: str) -> None:
        """Exactly this workspace's rows leave every table, as whole folders."""
        for name in schema.TABLES:
            fs, _ = self._fs(self.root)
            escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog \
                .ExternalCatalogUtils.escapePathName(workspace)
            self._remove(f"{self.path(name)}/workspace_id={escaped}")

    def _stored(self, name: str) -> DataFrame:
        wanted = self.schema(name)
        fields = wanted.fields + [T.StructField("bucket", T.IntegerType())]
        if not self.exists(name):
            return self.spark.createDataFrame([], T.StructType(fields))
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path(name))

    def _write(self, name: str, placed: DataFrame) -> None:
        (placed.hint("rebalance", *PARTITIONS).write.partitionBy(*PARTITIONS)
         .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path(name)))

    def _within(self, stored: DataFrame, touched: DataFrame, most: int = 2_000) -> DataFrame:
        """The rows of the touched partitions. A short list becomes a filter that prunes
        folders; a long one, which is most of the table, is joined."""
        listed = touched.limit(most + 1).collect()
        if len(listed) > most:
            return stored.join(touched, PARTITIONS, "left_semi")
        folders: dict[str, list[int]] = {}
        for row in listed:
            folders.setdefault(row["workspace_id"], []).append(row["bucket"])
        chosen = [(F.col("workspace_id") == w) & F.col("bucket").isin(b) for w, b in folders.items()]
        return stored.where(reduce(lambda a, b: a | b, chosen, F.lit(False)))

    def _replace(self, name: str, touched: DataFrame, change) -> None:
        touched = cut_lineage(touched)
        before = self._within(self._stored(name), touched)
        staging = f"{self.root}/_staging/{name}-{uuid.uuid4().hex}"
        change(before).write.parquet(staging)
        after = self.spark.read.parquet(staging)
        self._write(name, after)
        # a partition whose last row went is not part of the overwrite: drop its folder. The
        # list is folder names, as many as Spark itself tracks for the table.
        left = after.select(*PARTITIONS).distinct()
        for row in touched.join(left, PARTITIONS, "left_anti").toLocalIterator():
            escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog \
                .ExternalCatalogUtils.escapePathName(row["workspace_id"])
            self._remove(f"{self.path(name)}/workspace_id={escaped}/bucket={row['bucket']}")
        self._remove(staging)

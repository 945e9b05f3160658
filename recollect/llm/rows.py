"""Rows of the documents table: keys that survive nulls and repeated ids, whole rows carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_id(name: str = "doc_id") -> Column:
    """The id with null replaced by the smallest long, so that rows without id join as well."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def real_id(column: Column) -> Column:
    return F.when(column == NO_ID, F.lit(None).cast("long")).otherwise(column)


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """`id`, `tag` and text (null: empty), and the columns named. Rows equal in id and text are one
    document; rows equal in id only are told apart, and ordered, by `tag`, a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_id().alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"), *extra)


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("_whole"), row_id().alias("_id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_tag"))


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose key is among `keys` (id, tag)."""
    hit = (F.col("_id") == F.col("id")) & (F.col("_tag") == F.col("tag"))
    return _whole(docs).join(keys.select("id", "tag"), hit, "left_semi").select("_whole.*")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose key is not among `keys` (id, tag)."""
    hit = (F.col("_id") == F.col("id")) & (F.col("_tag") == F.col("tag"))
    return _whole(docs).join(keys, hit, "left_anti").select("_whole.*")

"""Folders on a mount that all executors share, listed and read by tasks.

Spark's own file sources pass over names that begin with `_` or `.`, which source trees and
vaults use for ordinary files, so the listing is done here: level by level, each level's folders
dealt out evenly.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from recollect.session import cut_and_count

ENTRIES_PER_BATCH = 5_000
BYTES_PER_BATCH = 16 << 20


def list_tree(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, length) of every file below `root`, paths relative to it. Folders named in `skip`
    are not entered, linked folders are not followed, and links out of the root are left out."""
    root = os.path.realpath(root)
    skipped = frozenset(skip)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for folder in batch["path"]:
                for entry in _entries(root, folder, skipped):
                    held.append(entry)
                    if len(held) >= ENTRIES_PER_BATCH:
                        yield _frame(held)
                        held = []
        yield _frame(held)

    level = spark.createDataFrame([("",)], "path STRING")
    files = None
    while True:
        found, count = cut_and_count(level.mapInPandas(entries, "path STRING, length BIGINT, folder BOOLEAN"))
        if not count:
            break
        plain = found.where("NOT folder").select("path", "length")
        files = plain if files is None else files.unionByName(plain)
        level = found.where("folder").select("path").repartition(spark.sparkContext.defaultParallelism)
    return files if files is not None else spark.createDataFrame([], "path STRING, length BIGINT")


def _entries(root: str, folder: str, skip: frozenset):
    """One folder's entries as (path, length, is a folder)."""
    try:
        with os.scandir(os.path.join(root, folder)) as listed:
            for entry in listed:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_symlink() and not _within(root, os.path.realpath(entry.path)):
                    continue
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in skip:
                        yield path, 0, True
                elif entry.is_file():
                    yield path, entry.stat().st_size, False
    except OSError:
        return


def _within(root: str, path: str) -> bool:
    return path == root or path.startswith(root.rstrip(os.sep) + os.sep)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({
        "path": pd.Series([r[0] for r in rows], dtype="object"),
        "length": pd.Series([r[1] for r in rows], dtype="int64"),
        "folder": pd.Series([r[2] for r in rows], dtype="bool")})


def read_files(listed: DataFrame, root: str) -> DataFrame:
    """The listed files with their bytes; files that cannot be read are left out."""
    root = os.path.realpath(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"]):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        held.append((path, int(length), f.read()))
                except OSError:
                    continue
                size += int(length)
                if size >= BYTES_PER_BATCH:
                    yield pd.DataFrame(held, columns=["path", "length", "content"], dtype="object")
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "length", "content"], dtype="object")

    cores = listed.sparkSession.sparkContext.defaultParallelism
    return listed.select("path", "length").repartition(cores).mapInPandas(
        read, "path STRING, length BIGINT, content BINARY")


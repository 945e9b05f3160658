"""JSON, code and evaluation files; export, import, backup."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect import schema
from recollect.functions.text import language_for
from recollect.operators.dml import reconcile
from recollect.operators.fingerprints import differences
from recollect.settings import MAX_CODE_FILE_BYTES, METADATA_KEYS
from recollect.sources.tree import list_tree, read_files

# Folders a code scan never enters.
SKIPPED_FOLDERS = (
    ".git", "node_modules", "vendor", "__pycache__", ".venv", "venv", "dist", "build", ".next",
    "target", ".idea", ".vscode", "bin", "obj", "exports", "vault-data",
)


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Usage lines; broken ones and ones without a time are skipped."""
    lines = spark.read.schema(schema.USAGE).option("mode", "DROPMALFORMED").json(path)
    return lines.where(F.col("ts").isNotNull())


def append_usage(lines: DataFrame, path: str) -> None:
    """A24."""
    lines.write.mode("append").json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One file of nodes and edges, or a folder of node and edge lines as `write_graph`
    leaves them (a single JSON document cannot be read in parallel)."""
    if path.endswith(".json"):
        doc = spark.read.schema(
            f"nodes ARRAY<STRUCT<{_ddl(schema.GRAPH_NODES)}>>, edges ARRAY<STRUCT<{_ddl(schema.GRAPH_EDGES)}>>"
        ).option("multiLine", "true").json(path)
        return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))
    return (spark.read.schema(schema.GRAPH_NODES).json(f"{path}/nodes"),
            spark.read.schema(schema.GRAPH_EDGES.replace("from ", "`from` ").replace("to ", "`to` ")).json(f"{path}/edges"))


def _ddl(columns: str) -> str:
    return ", ".join(f"`{n}`: {t}" for n, t in (c.split() for c in columns.split(",")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A26."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def inside(root: str, path: str) -> bool:
    """Whether a path, links resolved, lies in a root."""
    a, b = os.path.realpath(root), os.path.realpath(path)
    return b == a or b.startswith(a.rstrip(os.sep) + os.sep)


def jailed(path: str, roots: list[str]) -> str:
    """The resolved path, or an error when it lies outside all roots."""
    if not any(inside(r, path) for r in roots):
        raise ValueError("path outside indexable roots")
    return os.path.realpath(path)


def ignored_names(gitignore: str) -> set[str]:
    """Plain names of a .gitignore; patterns and paths are left out."""
    names = (line.strip().removesuffix("/").strip() for line in gitignore.split("\n"))
    return {n for n in names if n and not n.startswith("#") and "/" not in n and "*" not in n}


def scan_code(spark: SparkSession, root: str, roots: list[str] | None = None) -> DataFrame:
    """Every file below `root` with (path, length, language, ignored), paths relative to
    it; folders that are never indexed or that .gitignore names are not entered."""
    root = jailed(root, roots) if roots else os.path.realpath(root)
    ignore = Path(root, ".gitignore")
    names = sorted(ignored_names(ignore.read_text())) if ignore.is_file() else []
    listed = list_tree(spark, root, (*SKIPPED_FOLDERS, *names))
    name = F.element_at(F.split("path", "/"), -1)
    return listed.withColumns({"language": language_for(F.col("path")),
                               "ignored": name.isin(*names) if names else F.lit(False)})


def code_sources(listed: DataFrame, root: str) -> DataFrame:
    """The listed files that are indexed, as (path, source)."""
    fit = (F.col("language") != "") & ~F.col("ignored") & (F.col("length") <= MAX_CODE_FILE_BYTES)
    return read_files(listed.where(fit), root).select(
        "path", F.make_valid_utf8(F.col("content").cast("string")).alias("source"))


def eval_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(facts, queries) of an evaluation file."""
    rows = spark.read.schema("workspace_id STRING, session_id STRING, role STRING, content STRING, "
                             "query STRING, expected STRING").json(path)
    asked = F.coalesce("query", F.lit("")) != ""
    return (rows.where(~asked).select("workspace_id", "session_id", "role", "content"),
            rows.where(asked).select("workspace_id", "query", "expected"))


def export_workspace(chunks: DataFrame, workspace: str, path: str) -> None:
    """A31."""
    chunks.where(F.col("workspace_id") == workspace).drop("embedding").write.mode("overwrite").json(path)


def import_workspace(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """Exported chunks as messages for a batch write: empty texts are dropped, metadata is
    reduced to the known keys."""
    rows = spark.read.schema(schema.CHUNKS).json(path).where(F.coalesce("document", F.lit("")) != "")
    text = {k: F.col(k) for k in METADATA_KEYS if k not in ("chunk_id",)}
    text.update(tags=F.array_join("tags", ","), entities=F.array_join("entities", ","),
                importance=F.col("importance").cast("string"), chunk_id=F.col("vault_chunk_id"))
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in text.items()]
    metadata = F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    return rows.select(
        F.col("id").alias("message_id"), F.lit(workspace).alias("workspace_id"),
        F.coalesce("session_id", F.lit(f"migration-{workspace}")).alias("session_id"),
        F.coalesce("role", F.lit("user")).alias("role"), F.col("document").alias("content"),
        "scope", "peer_id", metadata.alias("metadata"), "created_at")


def backup(tables, path: str) -> None:
    """A copy of every table."""
    for name in schema.TABLES:
        if tables.exists(name):
            tables.read(name).write.mode("overwrite").parquet(f"{path}/{name}")


def verify_backup(tables, path: str, name: str = "chunks", key: str = "workspace_id") -> DataFrame:
    """Per workspace the live and the restored row counts."""
    restored = tables.spark.read.schema(tables.schema(name)).parquet(f"{path}/{name}")
    return reconcile(tables.read(name), restored, key)


def backup_differences(tables, path: str, name: str) -> DataFrame:
    """The keys of a table under which its copy differs, byte for byte."""
    live = tables.read(name)
    copy = tables.spark.read.schema(live.schema).parquet(f"{path}/{name}")
    return differences(live, copy, schema.KEYS[name])

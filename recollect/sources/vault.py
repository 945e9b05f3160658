"""Markdown vaults: scanning, skipping what is unchanged, turning files into messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.markdown import markdown_chunks
from recollect.functions.text import (clean_space, extract_entities, importance_for, keyword_tags,
                                      parent_doc_id)
from recollect.operators.skew import absent, join_lookup
from recollect.sources.tree import list_tree, read_files


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every `*.md` under `root` but the index folder, as (path, text, digest), paths
    relative to `root`."""
    listed = list_tree(spark, root, ("00-index",)).where(F.col("path").endswith(".md"))
    return read_files(listed, root).select(
        "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.sha2("content", 256).alias("digest"))


def changed(files: DataFrame, registry: DataFrame | None, reindex: bool = False) -> DataFrame:
    """Files whose digest is not the registered one."""
    if registry is None or reindex:
        return files
    return absent(files, registry, ["path", "digest"])


def left_over(stored: DataFrame, todo: DataFrame, written: DataFrame, found: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Stored chunks that a new version of their file no longer has, and those of registered files that are gone."""
    touched = todo.select(F.col("path").alias("source_path"))
    if registry is not None:
        touched = touched.unionByName(registry.join(found, "path", "left_anti").select(F.col("path").alias("source_path")))
    return absent(join_lookup(stored, touched.distinct(), ["source_path"], "left_semi"), written, ["workspace_id", "message_id"])


def messages(files: DataFrame, workspace: str, known_entities: list[str],
             language: str = "en") -> DataFrame:
    """Files as one message per chunk with their flat metadata, in the shape of the chunk table."""
    chunks = files.select(
        "path", F.sha2("text", 256).alias("file_hash"),
        F.posexplode(markdown_chunks(F.col("text"))).alias("i", "c"))
    header, body, path = F.col("c.header_path"), F.col("c.body"), F.col("path")
    doc = parent_doc_id(path)
    first_line = clean_space(F.regexp_extract(body, r"[^\n]*\S[^\n]*", 0))
    content = F.when(header != "", F.concat(F.lit("# "), header, F.lit("\n"), body)).otherwise(body)
    chunk_id = F.concat(doc, F.lit(":"), F.col("i").cast("string"))
    return chunks.select(
        chunk_id.alias("message_id"), F.lit(workspace).alias("workspace_id"),
        F.concat(F.lit("vault-"), doc).alias("session_id"), F.lit("system").alias("role"),
        content.alias("content"), F.lit("vault-md").alias("source_type"), path.alias("source_path"),
        header.alias("header_path"), F.col("c.chunk_type").alias("chunk_type"),
        keyword_tags(path, header).alias("tags"), importance_for(path).cast("double").alias("importance"),
        F.lit(workspace).alias("agent"), F.lit(language).alias("language"), doc.alias("parent_doc_id"),
        F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1).alias("doc_title"),
        extract_entities(body, header, known_entities).alias("entities"),
        F.left(first_line, F.lit(200)).alias("summary_1line"),
        chunk_id.alias("vault_chunk_id"), "file_hash")

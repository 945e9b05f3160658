"""A stored index of trigrams, so that grep and BM25 read the texts of candidates only.

`text_docs` holds for every indexed row its key, its length in words and `entry`, a hash of key and text; `text_grams` holds a row for each
distinct trigram of the lower-cased text, in the bucket of the trigram. A changed text has a new entry, so postings are only ever appended: those of
entries that are no longer in `text_docs` count for nothing, until `compact` drops them.

A substring of three signs or more can only be in texts that have all of its trigrams; one or two signs are in some trigram of every text that holds them (a
text of one or two signs is its own trigram). Candidates are found from postings, and their texts are then tested for the substring itself.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.slices import by_slices
from recollect.functions.text import word_count
from recollect.operators.lexical import bm25
from recollect.operators.skew import join_lookup
from recollect.session import cut_and_count, cut_lineage
from recollect.sources.tables import Tables

KEY = ["workspace_id", "id"]
GRAM = 3
LISTED_KEYS = 1_000  # up to this number of candidates their keys become filters of the scan


def grams(text: Column) -> Column:
    """The distinct trigrams of the lower-cased text, in Arrow batches; shorter texts are one gram, empty ones have none. (As a fold over the
    signs in the JVM this takes some fifty times as long.)"""
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else sorted({t[i:i + GRAM] for i in range(max(1, len(t) - GRAM + 1))}) if t else []
                         for t in texts.to_pylist()], pa.list_(pa.string()))

    return by_slices(cut, "array<string>", F.lower(text))


class TextIndex:
    def __init__(self, tables: Tables):
        self.tables, self.spark = tables, tables.spark

    # -- changes -----------------------------------------------------------------------------
    def add(self, rows: DataFrame) -> None:
        """Rows (workspace_id, id, document), new or with a changed text. Postings are written before the row counts as indexed, so a
        broken run leaves only postings without a row."""
        fresh = cut_lineage(rows.where(F.col("document").isNotNull()).select(
            *KEY, _entry().alias("entry"), word_count(F.lower("document")).cast("int").alias("words"), grams(F.col("document")).alias("grams")))
        self.tables.append("text_grams", fresh.select("workspace_id", "entry", F.explode("grams").alias("gram")))
        self.tables.merge("text_docs", fresh.drop("grams"))

    def remove(self, keys: DataFrame) -> None:
        self.tables.delete("text_docs", keys.select(*KEY))

    def prune(self, stored: DataFrame) -> None:
        """Forgets rows whose key is no longer stored; only keys are read."""
        gone = self.tables.read("text_docs").select(*KEY).join(stored.select(*KEY), KEY, "left_anti")
        self.tables.delete("text_docs", gone)

    def sync(self, rows: DataFrame) -> None:
        """The index of exactly these rows: new and changed ones are added, others forgotten."""
        known = self.tables.read("text_docs").select(*KEY, "entry")
        self.add(rows.withColumn("entry", _entry()).join(known, [*KEY, "entry"], "left_anti").drop("entry"))
        self.prune(rows.where(F.col("document").isNotNull()))

    def compact(self) -> None:
        """Drops the postings of entries that are no longer indexed."""
        alive = cut_lineage(self.tables.read("text_docs").select("workspace_id", "entry"))
        touched = self.tables._stored("text_grams").select("workspace_id", "bucket").distinct()
        self.tables._replace("text_grams", touched, lambda stored: stored.join(alive, ["workspace_id", "entry"], "left_semi"))

    # -- searches ----------------------------------------------------------------------------
    def _lowered(self, needles: list[str]) -> list[tuple[str, list[str]]]:
        """Each needle as the texts are lower-cased, by Spark, and its grams."""
        rows = self.spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "i INT, needle STRING").coalesce(1)
        return [(r["low"], r["grams"]) for r in rows.select("i", F.lower("needle").alias("low"), grams(F.col("needle")).alias("grams")).orderBy("i").collect()]

    def candidates(self, needles: list[str], workspaces: list[str] | None = None) -> DataFrame:
        """workspace_id and id of the rows that can hold one of the needles, from postings alone."""
        asked = self._lowered(needles) if needles else []
        within = F.col("workspace_id").isin(workspaces) if workspaces is not None else F.lit(True)
        docs = self.tables.read("text_docs").where(within)
        if any(not low for low, _ in asked):
            return docs.select(*KEY)
        entry, found = ["workspace_id", "entry"], []
        long = [parts for low, parts in asked if len(low) >= GRAM]
        if long:
            # at most as many grams for each entry as the needles have
            held = self.tables.having("text_grams", sorted({g for parts in long for g in parts})).where(within).groupBy(*entry).agg(
                F.collect_set("gram").alias("held"))
            all_of = [F.size(F.array_except(F.array(*map(F.lit, parts)), "held")) == 0 for parts in long]
            found.append(held.where(reduce(lambda a, b: a | b, all_of)).select(*entry))
        short = [F.contains("gram", F.lit(low)) for low, _ in asked if len(low) < GRAM]
        if short:
            found.append(self.tables.read("text_grams").where(within & reduce(lambda a, b: a | b, short)).select(*entry))
        if not found:
            return docs.select(*KEY).limit(0)
        return join_lookup(docs, reduce(DataFrame.union, found).distinct(), entry, "left_semi").select(*KEY)

    def texts_of(self, keys: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows with these keys. A short list of keys becomes a filter that reaches the scan and prunes folders."""
        keys, n = cut_and_count(keys)
        if n > LISTED_KEYS:
            return join_lookup(rows, keys, KEY, "left_semi")
        listed: dict[str, list[str]] = {}
        for k in keys.collect():
            listed.setdefault(k["workspace_id"], []).append(k["id"])
        chosen = [(F.col("workspace_id") == w) & F.col("id").isin(ids) for w, ids in listed.items()]
        return rows.where(reduce(lambda a, b: a | b, chosen, F.lit(False)))

    def grep(self, rows: DataFrame, needle: str, workspaces: list[str] | None = None) -> DataFrame:
        """The `rows` (the table that is indexed) whose text holds the needle in any case."""
        return self.texts_of(self.candidates([needle], workspaces), rows).where(F.contains(F.lower("document"), F.lower(F.lit(needle))))

    def bm25(self, rows: DataFrame, terms: list[str], workspaces: list[str] | None = None) -> DataFrame:
        """As `lexical.bm25` over all indexed rows of the workspaces: counts are taken from the candidates' texts, the number of texts and their
        mean length from `text_docs`."""
        docs = self.tables.read("text_docs")
        if workspaces is not None:
            docs = docs.where(F.col("workspace_id").isin(workspaces))
        size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("words").alias("mean")).first()
        return bm25(self.texts_of(self.candidates(terms, workspaces), rows), terms, corpus=(size["n"], size["mean"] or 0.0))


def _entry() -> Column:
    return F.xxhash64("workspace_id", "id", "document")

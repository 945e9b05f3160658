"""BM25 over substring frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recollect.functions.text import computed_once, substring_count, word_count
from recollect.operators.skew import join_lookup
from recollect.session import cut_lineage
from recollect.settings import BM25_B, BM25_K1


def _tf_columns(terms: list[str]) -> list[str]:
    return [f"_tf{i}" for i in range(len(terms))]


def term_frequencies(rows: DataFrame, terms: list[str], text: str = "document") -> DataFrame:
    """One pass over the texts: a column per query term and the length in words, in place of the
    text. The terms are constants, so this needs no join."""
    keep = [c for c in rows.columns if c != text]
    low = F.col("_low")
    return rows.select(*keep, computed_once(_low=F.lower(text))).select(
        *keep, word_count(low).cast("double").alias("_len"),
        *[substring_count(low, t).alias(name) for t, name in zip(terms, _tf_columns(terms))])


def corpus_stats(tf: DataFrame, terms: list[str], keys: list[str] | None = None) -> DataFrame:
    """Number of texts, mean length (empty texts count) and document frequencies."""
    return tf.groupBy(*(keys or [])).agg(*_stats(terms))


def _stats(terms: list[str]) -> list[Column]:
    return [F.count(F.lit(1)).cast("double").alias("_docs"), F.avg("_len").alias("_avg"),
            *[F.count_if(F.col(name) > 0).cast("double").alias(f"_df{i}")
              for i, name in enumerate(_tf_columns(terms))]]


def _score(terms: list[str], stat) -> Column:
    average = F.when(stat("_avg") == 0, 1.0).otherwise(stat("_avg"))
    total: Column = F.lit(0.0)
    for i, name in enumerate(_tf_columns(terms)):
        tf, df = F.col(name), stat(f"_df{i}")
        idf = F.ln(1 + (stat("_docs") - df + 0.5) / (df + 0.5))
        length = BM25_K1 * (1 - BM25_B + BM25_B * F.col("_len") / average)
        total = total + F.when(tf > 0, idf * tf * (BM25_K1 + 1) / (tf + length)).otherwise(0.0)
    return total


def bm25(rows: DataFrame, terms: list[str], keys: list[str] | None = None,
         text: str = "document", corpus: tuple[int, float] | None = None) -> DataFrame:
    """Rows with a score above zero, without their text. The corpus is `rows`, or with `keys`
    the rows of each key. If `rows` are only those of a larger corpus that hold a term, `corpus` gives its number of texts
    and their mean length.

    The texts are read once and never shuffled: the counts are written as a narrow table. For a
    single corpus its numbers are taken while the matching rows are written; with keys they are
    a lookup of one row per key, made from the narrow table.
    """
    tf = term_frequencies(rows, terms, text)
    if not terms:
        return tf.drop("_len").withColumn("bm25", F.lit(0.0)).limit(0)
    if keys:
        return bm25_counted(cut_lineage(tf), terms, keys)
    numbers = Observation()
    matching = cut_lineage(tf.observe(numbers, *_stats(terms)).where(_any_term(terms)))
    taken = numbers.get | ({"_docs": corpus[0], "_avg": corpus[1]} if corpus else {})
    found = {name: F.lit(float(n or 0.0)) for name, n in taken.items()}
    return matching.withColumn("bm25", _score(terms, found.__getitem__)).drop("_len", *_tf_columns(terms))


def bm25_counted(tf: DataFrame, terms: list[str], keys: list[str]) -> DataFrame:
    """The rows of written `term_frequencies` with a score above zero in the corpus of their key."""
    stats = corpus_stats(tf, terms, keys)
    names = [c for c in stats.columns if c not in keys]
    scored = join_lookup(tf.where(_any_term(terms)), stats, keys, "inner").withColumn("bm25", _score(terms, F.col))
    return scored.drop(*names, "_len", *_tf_columns(terms))


def _any_term(terms: list[str]) -> Column:
    """A score is above zero exactly where a term occurs, for every idf is positive."""
    return F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(n) for n in _tf_columns(terms)]) > 0

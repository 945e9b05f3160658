"""Fusing ranked lists and adjusting scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import clean_space
from recollect.operators.predicates import timeless
from recollect.settings import DECAY_RATE_PER_DAY, DECAY_START_HOURS, RRF_K


def rrf(lists: list[DataFrame], keys: list[str], rank: str = "rank") -> DataFrame:
    """Reciprocal rank fusion of lists of (keys, zero-based rank) to `fused` in [0, 1]."""
    union = lists[0].select(*keys, rank)
    for other in lists[1:]:
        union = union.unionByName(other.select(*keys, rank))
    top = 2.0 / RRF_K
    return union.groupBy(*keys).agg(
        F.least(F.lit(1.0), F.sum(1.0 / (RRF_K + F.col(rank))) / top).alias("fused"))


def decayed(distance: Column, created_at: Column, now: Column, exempt: Column) -> Column:
    """After a week distances grow exponentially with age."""
    hours = (F.unix_micros(now) - F.unix_micros(created_at)) / 3.6e9
    factor = F.exp(-DECAY_RATE_PER_DAY * (hours - DECAY_START_HOURS) / 24)
    return F.when(~exempt & (hours > DECAY_START_HOURS), distance / factor).otherwise(distance)


def decay(hits: DataFrame, now: Column) -> DataFrame:
    exempt = timeless(F.col("role"), F.col("importance"))
    return hits.withColumn("distance", decayed(F.col("distance"), F.col("created_at"), now, exempt))


def _lexical_feature(terms: list[str], text: Column, header: Column, tags: Column) -> Column:
    """Damped term counts; a term in the header or the tags counts once more."""
    everything = F.lower(F.concat_ws(" ", text, header, tags))
    header, tags = F.lower(header), F.lower(tags)
    total: Column = F.lit(0.0)
    for t in terms:
        count = ((F.char_length(everything) - F.char_length(F.replace(everything, F.lit(t), F.lit(""))))
                 / F.lit(float(len(t))))
        bonus = F.contains(header, F.lit(t)).cast("double") + F.contains(tags, F.lit(t)).cast("double")
        total = total + F.ln(1 + count + bonus)
    return F.least(F.lit(1.0), total / 3.0)


def _overlap(items: Column, names: list[str]) -> Column:
    """C11: the share of list items that the query names; repeated items count again."""
    wanted = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    hits = F.filter(items, lambda x: F.array_contains(wanted, F.lower(clean_space(x))))
    return F.coalesce(F.try_divide(F.size(hits).cast("double"), F.size(items).cast("double")), F.lit(0.0))


def entity_feature(names: list[str], entities: Column, tags: Column) -> Column:
    """Overlap with the entities, else half of the overlap with the tags. Both are lists."""
    by_entity, by_tag = _overlap(entities, names), _overlap(tags, names)
    return F.when(by_entity > 0, F.least(F.lit(1.0), 0.5 + 0.5 * by_entity)).otherwise(0.5 * by_tag)


def lexical_feature(terms: list[str]) -> Column:
    """The share of a rerank score that needs the text. It depends on one row only, so a scan can take it
    in passing and leave the text behind."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    return _lexical_feature(terms, F.col("document"), F.coalesce(F.col("header_path"), F.lit("")), F.concat_ws(",", tags))


def rerank_score(terms: list[str], low: Column, high: Column, lexical: Column | None = None) -> Column:
    """The weighted features of one hit, given the least and greatest distance of its set.
    `terms` keep their repetitions; `lexical` is a feature taken before."""
    span = F.when(high - low < 0.01, F.lit(0.5)).otherwise(high - low)
    empty = F.array().cast("array<string>")
    tags = F.coalesce(F.col("tags"), empty)
    entities = F.coalesce(F.col("entities"), empty)
    names = sorted({t for t in terms if len(t.encode()) >= 3})
    importance = F.coalesce((F.col("importance") - 1) / 4.0, F.lit(0.0))
    return (0.55 * (1 - (F.col("distance") - low) / span)
            + 0.25 * (lexical_feature(terms) if lexical is None else lexical)
            + 0.08 * importance
            + 0.07 * entity_feature(names, entities, tags)
            + 0.05 * 0.5)


def rerank(hits: DataFrame, terms: list[str], keys: list[str] | None = None,
           id_: str = "id", lexical: Column | None = None) -> DataFrame:
    """Reorders hit sets (bounded by the top-k before): adds `rerank` and the new zero-based
    `rank`. Sets of one hit keep their order."""
    keys = keys or []
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    scored = hits.withColumn(
        "rerank", rerank_score(terms, F.min("distance").over(group), F.max("distance").over(group), lexical))
    order = group.orderBy(F.col("rerank").desc(), F.col("distance"), F.col(id_))
    return scored.withColumn("rank", F.row_number().over(order) - 1)

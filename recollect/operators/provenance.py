"""Walks over reasoning edges for any number of seeds at once (I1-I3, E10): level by level to a given
depth, in doubling steps to any depth.

Every level joins its frontier, which is a written table of known size, to the link table:
small frontiers are broadcast, large ones shuffled with skew handling, as Spark sees fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import preview
from recollect.session import cut_and_count, cut_lineage
from recollect.settings import TRACE_DEPTH


def wanted_depth(depth: int) -> int:
    return depth if depth > 0 else TRACE_DEPTH


def links(edges: DataFrame) -> DataFrame:
    """One row per citation: `source` rests on `target`, by way of `via`."""
    cited = F.concat(
        F.transform("premise_ids", lambda p: F.struct(p.alias("target"), F.lit("premise").alias("via"))),
        F.transform("supporting_message_ids",
                    lambda p: F.struct(p.alias("target"), F.lit("supported_by").alias("via"))))
    return (edges.select(F.col("conclusion_id").alias("source"), F.explode(cited).alias("c"))
            .select("source", F.trim("c.target").alias("target"), "c.via").where("target <> ''"))


def _walk(seeds: DataFrame, step, depth: int) -> DataFrame | None:
    """Breadth first from (seed, id): `step(frontier)` gives (seed, id, via, go_on) candidates.
    Returns (seed, id, via, depth), an id counted at its first level."""
    frontier = seeds.select("seed", "id").distinct()
    seen, levels, level = frontier, [], 0
    while level < depth:
        level += 1
        found = step(frontier).groupBy("seed", "id").agg(
            F.min("via").alias("via"), F.bool_or("go_on").alias("go_on"))
        fresh, count = cut_and_count(found.join(seen, ["seed", "id"], "left_anti").withColumn(
            "depth", F.lit(level)))
        if count == 0:
            break
        levels.append(fresh)
        frontier = fresh.where("go_on").select("seed", "id")
        seen = seen.unionByName(fresh.select("seed", "id"))
    if not levels:
        return None
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.drop("go_on")


def _nothing(seeds: DataFrame) -> DataFrame:
    return seeds.select("seed", "id", F.lit("").alias("via"), F.lit(0).alias("depth")).limit(0)


def trace_forward(edges: DataFrame, seeds: DataFrame, depth: int = TRACE_DEPTH) -> DataFrame:
    """What a conclusion rests on. Premises are followed, messages end the walk."""
    known = cut_lineage(links(edges))  # read again at every level

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(known, frontier["id"] == known["source"]).select(
            "seed", F.col("target").alias("id"), "via", (F.col("via") == "premise").alias("go_on"))

    out = _walk(seeds, step, wanted_depth(depth))
    out = _nothing(seeds) if out is None else out
    # an id reached both ways on its level is a premise
    return out.withColumn("kind", F.when(F.col("via") == "premise", "conclusion").otherwise("message"))


def trace_reverse(edges: DataFrame, seeds: DataFrame, depth: int = TRACE_DEPTH) -> DataFrame:
    """The conclusions that depend on an id, with their distance in hops."""
    known = cut_lineage(links(edges))  # read again at every level

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(known, frontier["id"] == known["target"]).select(
            "seed", F.col("source").alias("id"), F.lit("cited_by").alias("via"),
            F.lit(True).alias("go_on"))

    out = _walk(seeds, step, wanted_depth(depth))
    return _nothing(seeds) if out is None else out


# The first levels are walked one by one: most chains are short, and squaring reads all links.
WALKED_LEVELS = 3
# Links are squared while the result has at most this many rows for each link (or SMALL_SQUARE rows in all).
SQUARE_GROWTH, SMALL_SQUARE = 4, 1_000_000


def _squared(hops: DataFrame, most: int) -> tuple[DataFrame, int] | None:
    """(source, target) of two hops in a row, written and counted, or None where the join would make more
    than `most` rows. How many it makes is known beforehand from the links into and out of each node."""
    into = hops.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = hops.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    made = into.join(out, "node").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0))).first()[0]
    if made > most:
        return None
    first = hops.withColumnRenamed("target", "middle")
    second = hops.withColumnRenamed("source", "middle")
    return cut_and_count(first.join(second, "middle").select("source", "target").distinct())


def reached(hops: DataFrame, seeds: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Everything that (source, target) links lead to from each (seed, id), to any depth: (seed, id, depth) with
    the least number of links; the starting ids have depth 0. Links may form circles; repeated links,
    repeated seeds and links with a null end change nothing.

    A round moves the last `step` levels on by `step` links at once, so that the levels known grow by
    `step`; links of `step` hops are squared whenever twice that many levels are known. A chain of n
    links takes some log2(n) rounds. Where nodes with many links in and out would make a square too large, the
    walk goes on with the step it has. `rounds`, if given, receives the step of each round.
    """
    hops, links_ = cut_and_count(hops.where("source IS NOT NULL AND target IS NOT NULL").distinct())
    most = max(SQUARE_GROWTH * links_, SMALL_SQUARE)
    known = cut_lineage(seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0)))
    levels, step, walked, squaring = 1, 1, 0, True
    while True:
        while squaring and walked >= WALKED_LEVELS and levels >= 2 * step:
            square = _squared(hops, most)
            squaring = square is not None
            if squaring:
                hops, n = square
                step *= 2
                if n == 0:  # no walk has that many links, so all levels are known
                    return known
        frontier = known.where(F.col("depth") >= levels - step)
        found = frontier.join(hops, frontier["id"] == hops["source"]).groupBy("seed", F.col("target").alias("id")).agg(
            (F.min("depth") + step).alias("depth"))
        fresh, n = cut_and_count(found.join(known.select("seed", "id"), ["seed", "id"], "left_anti"))
        walked += 1
        if rounds is not None:
            rounds.append(step)
        if n == 0:
            return known
        known = known.unionByName(fresh)
        levels += step


def reasoning_chain(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges behind a conclusion, to any depth, each with its distance from the seed."""
    behind = reached(links(edges).where("via = 'premise'").select("source", "target"), seeds)
    return behind.withColumnRenamed("id", "conclusion_id").join(edges, "conclusion_id")


def with_previews(trace: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first 300 bytes of each message in a trace."""
    texts = chunks.where("chunk_index = 0").select(
        F.col("message_id").alias("id"), preview(F.col("document"), 300).alias("document"))
    return trace.join(texts, "id", "left")

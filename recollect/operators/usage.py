"""Usage lines and their daily roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import day_key, sanitize_agent
from recollect.operators.skew import running
from recollect.session import cut_lineage
from recollect.settings import USAGE_RETENTION_DAYS, USAGE_TZ

ACTIONS = ("search", "store", "ask", "chat", "code", "upload")
# The counter names of the report, by action.
COUNTERS = {"search": "searches", "store": "stores", "ask": "ask", "chat": "chat",
            "code": "code", "upload": "upload", "other": "other"}


def normalise(lines: DataFrame) -> DataFrame:
    """Adds the local day and canonical action, source and agent."""
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("api"))
    return lines.withColumns({
        "day": day_key(F.col("ts"), USAGE_TZ),
        "agent": sanitize_agent(F.coalesce(F.col("agent"), F.lit("")), source),
        "source": source,
        "action": F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise("other"),
    })


def daily(usage: DataFrame, *keys: str) -> DataFrame:
    """One row per day with a counter per action. Counted map-side, so that a busy day
    costs no more than a quiet one in the shuffle."""
    return usage.groupBy(*(keys or ("day",))).agg(
        *[F.count_if(F.col("action") == a).alias(name) for a, name in COUNTERS.items()],
        F.count(F.lit(1)).alias("total"))


def by_dimension(usage: DataFrame) -> DataFrame:
    """Counts per day and source, agent or workspace, in one pass over the lines."""
    named = usage.withColumn("workspace", F.nullif(F.col("workspace"), F.lit("")))
    grouped = named.groupingSets(
        [[F.col("day"), F.col("source")], [F.col("day"), F.col("agent")],
         [F.col("day"), F.col("workspace")]],
        F.col("day"), F.col("source"), F.col("agent"), F.col("workspace")).agg(
            F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    # the grouping id has a bit per absent column: source 4, agent 2, workspace 1
    pick = (F.when(F.col("_g") == 3, F.struct(F.lit("source").alias("d"), F.col("source").alias("k")))
            .when(F.col("_g") == 5, F.struct(F.lit("agent").alias("d"), F.col("agent").alias("k")))
            .otherwise(F.struct(F.lit("workspace").alias("d"), F.col("workspace").alias("k"))))
    return grouped.select("day", pick["d"].alias("dimension"), pick["k"].alias("key"), "n").where(
        F.col("key").isNotNull())


def by_agent_action(usage: DataFrame) -> DataFrame:
    """D13, as rows."""
    return usage.groupBy("day", "agent", "action").agg(F.count(F.lit(1)).alias("n"))


def _map_of(key: str, value: str) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(key, value)))


def report(usage: DataFrame) -> DataFrame:
    """The daily report with its maps; the maps are built from counted rows."""
    dims = by_dimension(usage).groupBy("day", "dimension").agg(_map_of("key", "n").alias("m"))
    maps = dims.groupBy("day").agg(*[
        F.max_by("m", F.when(F.col("dimension") == d, 1)).alias(f"by_{d}")
        for d in ("source", "agent", "workspace")])
    nested = (by_agent_action(usage).groupBy("day", "agent").agg(_map_of("action", "n").alias("m"))
              .groupBy("day").agg(_map_of("agent", "m").alias("by_agent_action")))
    return daily(usage).join(maps, "day").join(nested, "day")


def days_until(spark, last_day: Column, n: int) -> DataFrame:
    """The calendar of the `n` days up to `last_day`."""
    n = n if n > 0 else 30
    last = last_day.cast("date")
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, n - 1), last)).alias("date"))
    return days.select(F.date_format("date", "yyyy-MM-dd").alias("day"))


def last_days(per_day: DataFrame, last_day: Column, n: int = 30) -> DataFrame:
    """The trailing series; quiet days count zero. The calendar has as many rows as days are asked for."""
    calendar = days_until(per_day.sparkSession, last_day, n)
    joined = F.broadcast(calendar).join(per_day, "day", "left")
    counts = [*COUNTERS.values(), "total"]
    return joined.select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def retained(usage: DataFrame, today: Column, days: int = USAGE_RETENTION_DAYS) -> DataFrame:
    """The lines that are kept."""
    return usage.where(F.col("day") >= F.date_format(F.date_sub(today.cast("date"), days), "yyyy-MM-dd"))


def sliding_count(events: DataFrame, key: str, ts: Column, seconds: float = 1.0,
                  out: str = "in_window") -> DataFrame:
    """For every distinct time of a key, the events in the `seconds` up to it (inclusive).

    Equal times are counted first. Each count stands once at its own time and once, with nothing to add, at the begin of its window;
    running sums over both kinds by range partitions then tell what there was up to now and before the window, and the difference is the
    answer. No key, window or stretch of time is ever one task's.
    """
    width = int(seconds * 1_000_000)
    counted = cut_lineage(events.groupBy(key, F.unix_micros(ts).alias("us")).agg(F.count(F.lit(1)).alias("n")))
    # at equal times what begins a window comes before what happens
    begins = counted.select(key, (F.col("us") - width).alias("at"), F.lit(0).alias("kind"), "us", F.lit(0).cast("bigint").alias("n"))
    both = begins.unionByName(counted.select(key, F.col("us").alias("at"), F.lit(1).alias("kind"), "us", "n"))
    summed = running(both.withColumn("_key", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))), ["_key"],
                     [F.col("at"), F.col("kind")], F.col("n"), total="upto")
    signed = F.when(F.col("kind") == 1, F.col("upto")).otherwise(-F.col("upto"))
    return summed.groupBy(key, "us").agg(F.sum("n").alias("n"), F.sum(signed).alias(out)).select(key, F.timestamp_micros("us").alias("ts"), "n", out)

"""The sliding-window rate limiter over a log of requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.skew import running


def decisions(requests: DataFrame, key: str, ts: Column, limit: int = 50,
              seconds: float = 1.0) -> DataFrame:
    """(key, us, n, accepted): of the `n` requests of a key at a time, how many pass. A request
    passes while fewer than `limit` passed within the window before it; refused ones do not
    count.

    The rule is serial, but a pause of one window empties it. Requests of equal time are
    counted first; slots one window wide show the pauses; each stretch between pauses is then
    read in time order as a stream that holds at most `limit` times in memory.
    """
    width = int(seconds * 1_000_000)
    counted = requests.groupBy(key, F.unix_micros(ts).alias("us")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("slot", F.floor(F.col("us") / width).cast("bigint"))
    slots = counted.groupBy(key, "slot").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    before = slots.select(key, (F.col("slot") + 1).alias("slot"), F.col("hi").alias("before"))
    begins = F.coalesce((F.col("lo") - F.col("before") >= width).cast("int"), F.lit(1))
    stretches = running(slots.join(before, [key, "slot"], "left").select(key, "slot", begins.alias("begins")),
                        [key], [F.col("slot")], F.col("begins"), total="stretch")
    placed = counted.join(stretches.select(key, "slot", "stretch"), [key, "slot"]).drop("slot")
    ordered = placed.repartition(key, "stretch").sortWithinPartitions(key, "stretch", "us")

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, passed = None, deque()
        for rows in batches:
            accepted = []
            for k, stretch, us, n in zip(rows[key], rows["stretch"], rows["us"], rows["n"]):
                if (k, stretch) != current:
                    current, passed = (k, stretch), deque()
                while passed and passed[0] <= us - width:
                    passed.popleft()
                take = min(n, limit - len(passed))
                passed.extend([us] * take)
                accepted.append(take)
            yield pd.DataFrame({key: rows[key], "us": rows["us"], "n": rows["n"], "accepted": accepted})

    kind = requests.schema[key].dataType.simpleString()
    return ordered.mapInPandas(admit, f"`{key}` {kind}, us BIGINT, n BIGINT, accepted BIGINT")

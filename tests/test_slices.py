"""Arrow UDFs that work on a part of a batch at a time."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import functions as F

from recollect.functions import slices




def test_slices_are_bounded_and_lose_nothing():
    texts = pa.array(["x" * (3 * slices.SLICE_BYTES), None, "", *["y" * 1000] * 5000])
    cuts = list(slices.slices(texts))
    assert [s.start for s in cuts[1:]] == [s.stop for s in cuts[:-1]] and (cuts[0].start, cuts[-1].stop) == (0, len(texts))
    for s in cuts:
        size = sum(len(t or "") for t in texts[s].to_pylist())
        assert s.stop - s.start == 1 or (s.stop - s.start <= slices.SLICE_ROWS and size <= slices.SLICE_BYTES)


def test_a_call_gets_a_slice_of_a_batch(spark):
    """9000 rows come in one batch; no call sees more than a slice of them."""
    sizes = lambda texts: pa.array([len(texts)] * len(texts), pa.int64())
    rows = spark.range(0, 9000, 1, 1).select(F.col("id").cast("string").alias("t"))
    seen = rows.select(slices.by_slices(sizes, "long", F.col("t")).alias("n"))
    assert seen.agg(F.max("n")).first()[0] == slices.SLICE_ROWS and seen.count() == 9000

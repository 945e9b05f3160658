"""Arrow UDFs that hold Python objects for a slice of a batch only, whatever the number of rows Spark puts in one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1024


def slices(texts: pa.Array) -> Iterator[slice]:
    """Consecutive rows of about `SLICE_BYTES` of text, one row at least and `SLICE_ROWS` at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        fits = np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_BYTES, "right")
        stop = int(min(max(fits, first + 1), first + SLICE_ROWS))
        yield slice(first, stop)
        first = stop


def by_slices(make: Callable[..., pa.Array], kind: str, sizes: Column, *others: Column, once: bool = False) -> Column:
    """The column `make(*arrays)` of type `kind`; `make` gets the rows of a batch some at a time, cut by the bytes of the
    texts in `sizes`, its first argument. With `once` a filter on the result stays above it; Spark would work it out again for the
    filter otherwise."""
    def run(*arrays: pa.Array) -> pa.Array:
        made = [make(*(a[s] for a in arrays)) for s in slices(arrays[0])]
        return pa.concat_arrays(made or [make(*arrays)])

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    column = F.arrow_udf(two if others else one, kind)
    return (column.asNondeterministic() if once else column)(sizes, *others)

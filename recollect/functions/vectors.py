"""Vector expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this width the dot product is unrolled into generated code; wider vectors go to numpy
# in Arrow batches, because the unrolled code would outgrow what the JVM compiles.
UNROLL_LIMIT = 128


def _balanced_sum(terms: list[str]) -> str:
    """A sum as a tree of logarithmic depth."""
    while len(terms) > 1:
        paired = [f"({a} + {b})" for a, b in zip(terms[::2], terms[1::2])]
        terms = paired + terms[len(paired) * 2:]
    return terms[0]


def norm(vector: Column) -> Column:
    """The length of a vector, to be stored next to it."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _unrolled_cosine(vector: str, query: list[float], stored_norm: str | None) -> Column:
    items = [f"CAST(get(`{vector}`, {i}) AS DOUBLE)" for i in range(len(query))]
    dot = _balanced_sum([f"{x} * {q!r}D" for x, q in zip(items, query)])
    length = f"`{stored_norm}`" if stored_norm else f"sqrt({_balanced_sum([f'{x} * {x}' for x in items])})"
    own = math.sqrt(math.fsum(q * q for q in query))
    return F.expr(f"try_divide({dot}, {length} * {own!r}D)")


def _batched_cosine(query: list[float]):
    q = np.asarray(query, dtype="float64")
    q_norm = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def cosine(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        fits = vectors.map(lambda v: v is not None and len(v) == len(q)).to_numpy(dtype=bool)
        if fits.any():
            m = np.stack(vectors[fits].to_numpy()).astype("float64")
            scale = np.sqrt((m * m).sum(axis=1)) * q_norm
            out[fits] = np.divide(m @ q, scale, out=np.full(len(m), np.nan), where=scale > 0)
        return pd.Series(out)

    return cosine


def cosine_distance(vector: str, query: list[float], stored_norm: str | None = None) -> Column:
    """`1 - cosine` to a column of vectors as wide as the query; 1 for zero vectors."""
    query = [float(x) for x in query]
    if len(query) <= UNROLL_LIMIT:
        cosine = _unrolled_cosine(vector, query, stored_norm)
    else:
        cosine = F.nullif(_batched_cosine(query)(F.col(vector)), F.lit(float("nan")))
    return F.lit(1.0) - F.coalesce(cosine, F.lit(0.0))


def score(distance: Column) -> Column:
    """H13."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)

"""Embedding near-dedup (12): links between vectors of one label whose cosine is at least `COSINE`, by PCA-ordered tiled comparison.

1. Vectors become unit vectors in double precision. Vectors of one label that are equal in every component are one vector with a weight.
2. The second moments of all unit vectors (sums of a task each, added up) give an orthogonal basis, axes by falling variance; for
   vectors wider than `PCA_WIDTH`, or of another width than the most common one, the axes stay as they are. The basis changes the speed only.
3. Vectors of one label and width are sorted into strips of the first axis and by the second axis inside, and cut into tiles of
   `TILE_BYTES`. A tile carries bounds of its leading coordinates and the largest norm of what follows them (the suffix).
4. Pairs of tiles whose bounds leave no room for the threshold are dropped; the others are compared in parts of `PART` rows. Products of the leading
   axes are accumulated first; what the rest can add is at most the product of the suffix norms. Rows and columns without any pair that
   can still reach the threshold leave; the comparison stops when none is left. Pairs that remain are decided by the full product.
5. Each comparison hands on the number of links of each vector and a spanning forest of its links, never the pairs. Components are found from the forests.

Hot groups: a label is many tiles, sorted and numbered by range partitions; equal vectors meet in partial aggregation. Comparisons of a label
grow with the square of its tiles that lie near each other, rows with its tiles.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label, link with nothing: no links, a component
of their own, kept. Vectors of unequal width are not compared. Rows that share a vec_id are vectors of their own. A null vec_id counts as the smallest
and is shown as null. Further columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.components import components
from recollect.llm.rows import real_id, row_id
from recollect.operators.skew import join_lookup
from recollect.session import cut_lineage

COSINE = 0.93
PCA_WIDTH = 1024
TILE_BYTES = 2 << 20
PART = 512
LEAD = 8  # axes of the first step; each next one takes twice as many
STRIPS = 64
SLACK = 1e-9  # of bounds, far above the rounding of double products

UNIT = "vec long, group string, width int, unit binary"


def units(embeddings: DataFrame) -> DataFrame:
    """vec, group (the label), width and the unit vector (doubles; null if it can't link) of every row, written."""
    def unit(values) -> bytes | None:
        values = values.values
        if values is None or values.null_count or not len(values):
            return None
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(x).all() or not x.any():
            return None
        x = x / np.abs(x).max()  # so that no square overflows or vanishes
        return (x / np.sqrt(x @ x)).tobytes()

    def run(batches):
        for batch in batches:
            made = [unit(v) if g else None for g, v in zip(batch.column("group").is_valid().to_pylist(), batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("group"), pa.array([len(m) // 8 if m else 0 for m in made], pa.int32()),
                                              pa.array(made, pa.binary())], names=["vec", "group", "width", "unit"])

    rows = embeddings.select(row_id("vec_id").alias("vec"), F.col("label").cast("string").alias("group"), "embedding")
    return cut_lineage(rows.mapInArrow(run, UNIT))


def basis(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The most common width and an orthogonal basis for it, axes by falling second moment: one matrix for each task is added up."""
    common = vectors.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    width = common["width"] if common else 0
    if not width or width > PCA_WIDTH:
        return width, np.eye(min(width, PCA_WIDTH))

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist())).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["line", "sums"])

    sums = vectors.where(F.col("width") == width).select("unit").mapInArrow(run, "line long, sums array<double>")
    lines = sums.select("line", F.posexplode("sums").alias("place", "x")).groupBy("line", "place").agg(F.sum("x").alias("x")).toPandas()
    moments = np.zeros((width, width))
    moments[lines["line"], lines["place"]] = lines["x"]
    return width, np.linalg.eigh(moments)[1][:, ::-1]


DISTINCT = "vec long, group string, width int, weight long, unit binary, turned binary, c0 double, c1 double"


def _turned(distinct: DataFrame, width: int, axes: np.ndarray) -> DataFrame:
    """With the coordinates in the basis (single precision: for bounds only) and the first two of them."""
    held = distinct.sparkSession.sparkContext.broadcast(axes)

    def run(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            made = [np.frombuffer(u) for u in batch.column("unit").to_pylist()]
            common = np.flatnonzero(widths == width) if 0 < width <= PCA_WIDTH else []
            if len(common):
                for k, x in zip(common, np.stack([made[k] for k in common]) @ held.value):
                    made[k] = x
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec", "group", "width", "weight", "unit")), pa.array([x.astype(np.float32).tobytes() for x in made], pa.binary()),
                 pa.array([float(x[0]) for x in made], pa.float64()), pa.array([float(x[min(1, len(x) - 1)]) for x in made], pa.float64())],
                names=[c.split()[0] for c in DISTINCT.split(", ")])

    return distinct.mapInArrow(run, DISTINCT)


TILE = ("group string, width int, tile long, vecs binary, weights binary, units binary, turned binary, low array<double>, high array<double>, "
        "suffix double")


def tile_rows(width: int) -> int:
    """Vectors of a tile: doubles and singles of all fill `TILE_BYTES`."""
    return max(16, TILE_BYTES // (12 * width))


def tiles(distinct: DataFrame) -> DataFrame:
    """Tiles of vectors that lie near each other on the first two axes, with bounds of their leading coordinates. Each task cuts
    its range of the sorted vectors."""
    keys = ["group", "width"]
    bounds = distinct.groupBy(*keys).agg(F.percentile_approx("c0", [k / STRIPS for k in range(1, STRIPS)], 1000).alias("cuts"), F.count(F.lit(1)).alias("n"))
    strips = F.least(F.lit(STRIPS), F.ceil(F.sqrt(F.col("n") * F.lit(12) * F.col("width") / TILE_BYTES)))
    strip = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("c0"))) * strips / STRIPS)
    order = [*keys, "strip", "c1", "vec"]

    def run(batches):
        key, held, k = None, [], TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "width", "vec", "weight", "unit", "turned"))):
                if held and (row[:2] != key or len(held) == tile_rows(key[1])):
                    yield _tile((*key, k), held)
                    held, k = [], k + 1
                key = row[:2]
                held.append(row[2:])
        if held:
            yield _tile((*key, k), held)

    ordered = join_lookup(distinct, bounds, keys).withColumn("strip", strip).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ordered.select("group", "width", "vec", "weight", "unit", "turned").mapInArrow(run, TILE))


def _tile(key, held) -> pa.RecordBatch:
    vecs, weights, unit, turned = zip(*held)
    x = np.frombuffer(b"".join(turned), np.float32).reshape(len(held), -1).astype(np.float64)
    row = {"group": key[0], "width": key[1], "tile": key[2], "vecs": np.array(vecs, "<i8").tobytes(), "weights": np.array(weights, "<i8").tobytes(),
           "units": b"".join(unit), "turned": b"".join(turned), "low": x[:, :LEAD].min(axis=0).tolist(), "high": x[:, :LEAD].max(axis=0).tolist(),
           "suffix": float(np.sqrt((x[:, LEAD:] ** 2).sum(axis=1)).max())}
    doubles = pa.list_(pa.float64())
    kinds = dict(group=pa.string(), width=pa.int32(), tile=pa.int64(), vecs=pa.binary(), weights=pa.binary(), units=pa.binary(), turned=pa.binary(),
                 low=doubles, high=doubles, suffix=pa.float64())
    return pa.RecordBatch.from_pylist([row], pa.schema(kinds.items()))


def near_tiles(table: DataFrame, cosine: float) -> DataFrame:
    """group, width, a, b: pairs of tiles (a <= b) whose bounds leave room for the cosine: neither the gap between their boxes of leading
    coordinates, nor the largest product of the boxes with the suffix norms, rules it out."""
    meta = table.select("group", "width", "tile", "low", "high", "suffix")
    a = meta.select("group", "width", *(F.col(c).alias(f"a_{c}") for c in ("tile", "low", "high", "suffix")))
    b = meta.select("group", "width", *(F.col(c).alias(f"b_{c}") for c in ("tile", "low", "high", "suffix")))
    gap = F.aggregate(F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y)),
                      F.lit(0.0), lambda s, x: s + F.pow(F.greatest(x, F.lit(0.0)), 2))
    corners = F.zip_with(F.zip_with("a_low", "a_high", lambda x, y: F.struct(x.alias("l"), y.alias("h"))),
                         F.zip_with("b_low", "b_high", lambda x, y: F.struct(x.alias("l"), y.alias("h"))),
                         lambda x, y: F.greatest(x["l"] * y["l"], x["l"] * y["h"], x["h"] * y["l"], x["h"] * y["h"]))
    most = F.aggregate(corners, F.lit(0.0), lambda s, x: s + x) + F.col("a_suffix") * F.col("b_suffix")
    room = (F.col("a_tile") == F.col("b_tile")) | (gap <= 2 - 2 * cosine + 1e-5) & (most >= cosine - 1e-5)
    return a.join(b, ["group", "width"]).where((F.col("a_tile") <= F.col("b_tile")) & room).select(
        "group", "width", F.col("a_tile").alias("a"), F.col("b_tile").alias("b"))


# --- comparison --------------------------------------------------------------------------------------

class Side:
    """The vectors of a part of a tile: as they are, in the basis, and the norms of what follows each step."""

    def __init__(self, vecs: bytes, weights: bytes, units: bytes, turned: bytes, width: int):
        self.vecs, self.weights = np.frombuffer(vecs, "<i8"), np.frombuffer(weights, "<i8")
        self.units = np.frombuffer(units).reshape(-1, width)
        self.turned = np.frombuffer(turned, np.float32).reshape(-1, width).astype(np.float64)
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.suffix = {k: np.sqrt(squares[:, k]) if k < width else np.zeros(len(self.vecs)) for k in steps(width)}


def steps(width: int) -> list[int]:
    """Numbers of axes after which bounds are tested."""
    out, k = [], LEAD
    while k < width:
        out.append(k)
        k *= 2
    return [*out, width]


def compare(x: Side, y: Side, i: np.ndarray, j: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (of i, of j) of the pairs whose cosine is at least the threshold. i and j number rows of x and y."""
    width = x.units.shape[1]
    rows, columns, done = i, j, 0
    product = np.zeros((len(i), len(j)))
    for k in steps(width)[:-1]:
        product += x.turned[rows, done:k] @ y.turned[columns, done:k].T
        able = product + np.outer(x.suffix[k][rows], y.suffix[k][columns]) >= cosine - 1e-5  # single precision
        some, others = able.any(axis=1), able.any(axis=0)
        if not some.any():
            none = np.zeros(0, np.int64)
            return none, none
        rows, columns, done = rows[some], columns[others], k
        product = product[some][:, others]
        if able.mean() > 0.3:
            break  # dense: the full product decides at once
    hit = x.units[rows] @ y.units[columns].T
    a, b = np.nonzero(hit >= cosine - SLACK)
    close = hit[a, b] < cosine + SLACK  # decided by the product of the two vectors alone, like any pair elsewhere
    keep = np.ones(len(a), bool)
    for k in np.flatnonzero(close):
        keep[k] = float(np.dot(x.units[rows[a[k]]], y.units[columns[b[k]]])) >= cosine
    return rows[a[keep]], columns[b[keep]]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root (smallest number reached) for each of n nodes; by rounds of least neighbours and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


FOUND = "kind int, vec long, other long, n long"


def compared(table: DataFrame, cosine: float) -> DataFrame:
    """Rows of kind 0: vec and the links (by weight) that one comparison of tiles found for it; of kind 1: vec and other, an edge of a forest."""
    pairs = near_tiles(table, cosine)
    blobs = ("vecs", "weights", "units", "turned")
    left = table.select("group", "width", F.col("tile").alias("a"), *(F.col(c).alias(f"a_{c}") for c in blobs))
    right = table.select("group", "width", F.col("tile").alias("b"), *(F.col(c).alias(f"b_{c}") for c in blobs))
    joined = pairs.join(left.hint("merge"), ["group", "width", "a"]).join(right.hint("merge"), ["group", "width", "b"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                width, a, b = (batch.column(c)[k].as_py() for c in ("width", "a", "b"))
                x = Side(*(batch.column(f"a_{c}")[k].as_py() for c in blobs), width)
                y = x if a == b else Side(*(batch.column(f"b_{c}")[k].as_py() for c in blobs), width)
                yield from _compared(x, y, a == b, cosine)

    return cut_lineage(joined.select("width", "a", "b", *(f"{s}_{c}" for s in "ab" for c in blobs)).mapInArrow(run, FOUND))


def _compared(x: Side, y: Side, same: bool, cosine: float):
    n = len(x.vecs)
    shift = 0 if same else n
    weight_x, weight_y = np.zeros(n, np.int64), np.zeros(len(y.vecs), np.int64)
    root = np.arange(n + (0 if same else len(y.vecs)))
    for lo in range(0, n, PART):
        for to in range(lo if same else 0, len(y.vecs), PART):
            a, b = compare(x, y, np.arange(lo, min(lo + PART, n)), np.arange(to, min(to + PART, len(y.vecs))), cosine)
            if same and lo == to:
                a, b = a[a < b], b[a < b]
            weight_x += np.bincount(a, y.weights[b], n).astype(np.int64)
            weight_y += np.bincount(b, x.weights[a], len(y.vecs)).astype(np.int64)
            new = _forest(len(root), root[a], root[b + shift])
            root = new[root]
    every = x.vecs if same else np.concatenate([x.vecs, y.vecs])
    n_links = weight_x + weight_y if same else np.concatenate([weight_x, weight_y])
    linked, tied = np.flatnonzero(n_links), np.flatnonzero(root != np.arange(len(root)))
    kinds = np.concatenate([np.zeros(len(linked)), np.ones(len(tied))]).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(kinds), pa.array(np.concatenate([every[linked], every[tied]])),
         pa.array(np.concatenate([every[linked], every[root[tied]]])), pa.array(np.concatenate([n_links[linked], np.zeros(len(tied), np.int64)]))],
        names=["kind", "vec", "other", "n"])


def links(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row; all other columns of the rows are left out."""
    every = units(embeddings)
    vectors = every.where("unit IS NOT NULL")
    width, axes = basis(vectors)
    same = ("group", "width", "unit")
    # equal vectors are one, with a number of its own, as ids may repeat
    classes = cut_lineage(vectors.groupBy(*same).agg(F.min("vec").alias("least"), F.count(F.lit(1)).alias("weight"))
                          .withColumn("vec", F.monotonically_increasing_id()))
    found = compared(tiles(_turned(classes.select("vec", "group", "width", "weight", "unit"), width, axes)), cosine)
    counts = found.where("kind = 0").groupBy("vec").agg(F.sum("n").alias("n"))
    roots = components(found.where("kind = 1"), "vec", "other").withColumnRenamed("node", "vec")
    named = cut_lineage(classes.select("vec", "group", "width", F.md5("unit").alias("digest"), "least", "weight").join(counts, "vec", "left")
                        .join(roots, "vec", "left").withColumn("root", F.coalesce("root", "vec")))
    component = named.groupBy("root").agg(F.min("least").alias("component"))  # named by its smallest id
    named = join_lookup(named, component, ["root"]).select(
        "group", "width", "digest", "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    own = join_lookup(vectors.select("vec", "group", "width", F.md5("unit").alias("digest")), named, ["group", "width", "digest"])
    lonely = every.where("unit IS NULL").select("vec", F.lit(0).alias("n_links"), F.col("vec").alias("component"))
    return own.select("vec", "n_links", "component").unionByName(lonely).select(
        real_id(F.col("vec")).alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), real_id(F.col("component")).alias("component_id"),
        (F.col("vec") == F.col("component")).alias("kept"))

"""N-gram Jaccard join (8): Bayesian candidate pruning, then exact verification.

Documents are sets of shingles of five words ([^\\x20\\x09-\\x0D]+, case kept; a text of fewer words is one
shingle). Two documents are linked if the Jaccard similarity of their sets is 0.8 or more.

1. Documents with equal sets become one representative with a number of copies.
2. Representatives that share one of 32 bands of five MinHash values are candidates (a pair at 0.8 shares
   none with probability 3e-6). Frequent bands are cut into blocks of about `BLOCK` members, compared block by block.
3. A pair is compared on other MinHash values, `STEP` at a time. With a uniform prior the similarity after
   m matches of n has the posterior Beta(m+1, n-m+1); the pair goes as soon as the probability of 0.8 or more
   is below `TOLERANCE`.
4. The surviving links only tell which documents belong together; a task sends one edge for each member to
   the smallest of its part, never pairs. Inside each component, again in blocks, all pairs are pruned the same way and
   verified on the shingle sets; the task returns each member's number of links and again a spanning set of edges.

So a group of n different near copies costs n^2/2 comparisons inside tasks of fixed size, which is what
counting its links takes, but only rows in proportion to n * n / BLOCK are moved and none for each pair.

Cases: null or empty texts, and texts without words, have no shingle and no link; each is a class of its own.
Repeated rows are copies. Null ids stay null and sort first. Ties: the class id is the smallest
doc_id in the class (null if one of its rows has none). An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import flat, rows
from recollect.llm.components import components
from recollect.session import cut_and_count, cut_lineage

WIDTH = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 5
COMPARED, STEP = 96, 16
TOLERANCE = 1e-6
BLOCK, BLOCK_BYTES = 256, 4 << 20
BROADCAST_ROWS = 200_000  # of two or three longs each

SIGNED = "id long, tag long, fp1 long, fp2 long, bands array<long>, mins binary"


# --- signatures --------------------------------------------------------------------------------------

def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the text of each."""
    starts, ends, of = flat.blank_words(data, at)
    hashes, who = flat.shingles(flat.run_hashes(data, starts, ends), of, len(at) - 1, WIDTH)
    order = np.lexsort((hashes, who))
    hashes, who = hashes[order], who[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])
    return hashes[new], who[new]


def min_hashes(hashes: np.ndarray, who: np.ndarray, n: int, count: int) -> np.ndarray:
    """(n, count) MinHash values; a text without shingles has the largest value everywhere."""
    draw = np.random.default_rng(8)
    low, high = draw.integers(0, 1 << 32, (2, count), dtype=np.uint32) | np.uint32(1)
    out = np.full((n, count), 0xFFFFFFFF, np.uint32)
    if len(hashes):
        present, first = np.unique(who, return_index=True)
        a, b = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(count):
            out[present, k] = np.minimum.reduceat(a * low[k] + b * high[k], first)
    return out


def _sums(values: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    at = np.searchsorted(who, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def signed(docs: DataFrame) -> DataFrame:
    """Key, fingerprint of the shingle set, band keys and MinHash values of each document with words."""
    def run(batches):
        for batch in batches:
            for part in flat.slices(batch):
                data, at = flat.flatten(part.column("text"))
                n = len(at) - 1
                hashes, who = shingle_sets(data, at)
                mins = min_hashes(hashes, who, n, BANDS * BAND_ROWS + COMPARED)
                bands = np.stack([flat.window_hashes(row.astype(np.uint64), BAND_ROWS, 11)[::BAND_ROWS]
                                  for row in mins[:, :BANDS * BAND_ROWS]]) if n else np.zeros((0, BANDS), np.uint64)
                bands = flat.mix(bands + np.arange(BANDS, dtype=np.uint64)[None, :])
                fp1, fp2 = _sums(flat.mix(hashes), who, n), _sums(flat.mix(hashes ^ np.uint64(0xABCD1234)), who, n)
                held = np.bincount(who, minlength=n) > 0
                short = np.ascontiguousarray(mins[:, BANDS * BAND_ROWS:].astype(np.uint16))
                where = pa.array(held)
                made = [part.column("id"), part.column("tag"), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64))),
                        pa.array([row.tobytes() for row in short], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["id", "tag", "fp1", "fp2", "bands", "mins"]).filter(where)

    return rows.keyed(docs).mapInArrow(run, SIGNED)


# --- pruning -----------------------------------------------------------------------------------------

def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values the fewest matches with which a pair goes on.

    P(similarity >= t | m of n) = 1 - I_t(m + 1, n - m + 1) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def prune(mins: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose posterior probability stays above the tolerance at every step."""
    matches = np.zeros(len(i), np.int32)
    for k, needed in enumerate(least):
        if not len(i):
            break
        part = mins[:, k * STEP:(k + 1) * STEP]
        matches += (part[i] == part[j]).sum(axis=1, dtype=np.int32)
        on = matches >= needed
        i, j, matches = i[on], j[on], matches[on]
    return i, j


def all_pairs(block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs inside one block, or between two."""
    if lo == hi:
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indices is linked to, directly or not."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def in_blocks(members: DataFrame, group: str, carried: list[str], n_blocks) -> DataFrame:
    """Rows (group, lo, hi, members): each pair of blocks of each group, and each block alone in groups
    of one block. A member's block follows from its id; a list holds two blocks at most."""
    placed = members.withColumn("_nb", n_blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("_nb")).cast("int"))
    dealt = placed.withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col("_nb") - 1).cast("int"))))
    return dealt.groupBy(group, F.least("block", "_j").alias("lo"), F.greatest("block", "_j").alias("hi")).agg(
        F.collect_list(F.struct("rid", "block", *carried)).alias("members"))


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all representatives linked by pairs that survive pruning."""
    posts = reps.select("rid", F.explode("bands").alias("key"))
    shared = cut_lineage(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    held = posts.join(shared, "key").join(reps.select("rid", "mins"), "rid")
    blocks = in_blocks(held, "key", ["mins"], F.ceil(F.col("n") / BLOCK))
    least = least_matches()

    def run(batches):
        for batch in batches:
            a, b = [], []
            for lo, hi, members in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "members"))):
                if len(members) < 2:
                    continue
                rid = np.array([m["rid"] for m in members])
                mins = np.frombuffer(b"".join(m["mins"] for m in members), np.uint16).reshape(len(rid), -1)
                i, j = prune(mins, *all_pairs(np.array([m["block"] for m in members]), lo, hi), least)
                if len(i):
                    root = roots(len(rid), i, j)
                    moved = root != np.arange(len(rid))
                    a.append(rid[root[moved]])
                    b.append(rid[moved])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


# --- verification ------------------------------------------------------------------------------------

def linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD):
    """The pairs with exact Jaccard similarity of `threshold` or more."""
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 64:
        shared = np.array([np.intersect1d(sets[x], sets[y], assume_unique=True).size for x, y in zip(i, j)], np.int64)
    else:
        shared = _overlaps(sets)[i, j]
    on = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
    return i[on], j[on]


def _overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections: products of the membership matrix, some columns at a time."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[0], (values[1:] != values[:-1]).astype(np.int64)]))
    total = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [first, first + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        total += held @ held.T
    return np.rint(total).astype(np.int64)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, root, copies, mins and the shingle set of the representatives wanted (by id and tag)."""
    wanted, n = cut_and_count(wanted)
    keys = wanted.select("id", "tag", "rid")
    texts = rows.keyed(docs).join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, ["id", "tag"])

    def run(batches):
        for batch in batches:
            for part in flat.slices(batch):
                data, at = flat.flatten(part.column("text"))
                hashes, who = shingle_sets(data, at)
                cut = np.searchsorted(who, np.arange(len(at)))
                sets = [hashes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(sets, pa.binary())], names=["rid", "shingles"])

    # a repeated row gives its set twice
    sets = texts.select("rid", "text").mapInArrow(run, "rid long, shingles binary").groupBy("rid").agg(F.max("shingles").alias("shingles"))
    return cut_lineage(sets.join(wanted.drop("id", "tag"), "rid"))


def verified(sets: DataFrame) -> DataFrame:
    """Rows (rid, other, links): links of a representative found by one task, counted with copies, or an
    edge between two representatives of one class (links 0)."""
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    n_blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
    blocks = in_blocks(sets.join(cut_lineage(sizes), "root"), "root", ["copies", "mins", "shingles"], n_blocks)
    least = least_matches()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lo, hi, members = (batch.column(c)[k].as_py() for c in ("lo", "hi", "members"))
                if len(members) < 2:
                    continue
                rid = np.array([m["rid"] for m in members])
                copies = np.array([m["copies"] for m in members])
                mins = np.frombuffer(b"".join(m["mins"] for m in members), np.uint16).reshape(len(rid), -1)
                i, j = prune(mins, *all_pairs(np.array([m["block"] for m in members]), lo, hi), least)
                if not len(i):
                    continue
                i, j = linked([np.frombuffer(m["shingles"], np.uint64) for m in members], i, j)
                links = np.bincount(i, copies[j], len(rid)) + np.bincount(j, copies[i], len(rid))
                root = roots(len(rid), i, j)
                some = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid[some]), pa.array(rid[root[some]]), pa.array(links[some].astype(np.int64))], names=["rid", "other", "links"])

    return blocks.mapInArrow(run, "rid long, other long, links long")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: id, tag, class_id (smallest id of its class), n_links (documents linked to
    it, copies among them) and first (whether it is the first document of its class by id and tag)."""
    marks = cut_lineage(signed(docs))
    reps = cut_lineage(marks.groupBy("fp1", "fp2").agg(
        F.min(F.struct("id", "tag")).alias("first"), F.count(F.lit(1)).alias("copies"),
        F.max("bands").alias("bands"), F.max("mins").alias("mins")).withColumn("rid", F.monotonically_increasing_id()))
    near = components(candidates(reps))
    wanted = reps.join(near.select(F.col("node").alias("rid"), "root"), "rid").select(
        F.col("first.id").alias("id"), F.col("first.tag").alias("tag"), "rid", "root", "copies", "mins")
    found = cut_lineage(verified(_sets_of(docs, wanted)))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rid").alias("a"), F.col("other").alias("b")))
    told = (reps.select("fp1", "fp2", "first", "copies", "rid")
            .join(links, "rid", "left").join(joined.select(F.col("node").alias("rid"), "root"), "rid", "left")
            .withColumn("root", F.coalesce("root", "rid")))
    least = told.groupBy("root").agg(F.min("first").alias("least"))
    by_set = cut_lineage(told.join(least, "root").select(
        "fp1", "fp2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    with_words = marks.select("id", "tag", "fp1", "fp2").join(by_set, ["fp1", "fp2"]).select(
        "id", "tag", F.col("least.id").alias("class_id"), "n_links",
        ((F.col("id") == F.col("least.id")) & (F.col("tag") == F.col("least.tag"))).alias("first"))
    without = rows.keyed(docs).where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        "id", "tag", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return with_words.union(without)


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id and n_links."""
    return classes(docs).select(rows.real_id(F.col("id")).alias("doc_id"), rows.real_id(F.col("class_id")).alias("class_id"), "n_links")


def keep_first(docs: DataFrame) -> DataFrame:
    """The first document of each class, all columns as they are. Of rows repeated in id and text one stays."""
    told = cut_lineage(classes(docs))
    gone, n = cut_and_count(told.where("not first").select("id", "tag").distinct())
    kept = rows.without(docs, F.broadcast(gone) if n <= BROADCAST_ROWS else gone)
    repeated, n = cut_and_count(told.where("first").groupBy("id", "tag").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "tag"))
    if not n:
        return kept
    once = rows.keep_rows(docs, repeated)
    one = once.select(F.struct("*").alias("_whole"), rows.row_id().alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    wordless = one.where(~F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    single = one.where(F.col("_text").rlike(r"[^\x20\x09-\x0D]")).groupBy("_id", "_text").agg(F.first("_whole").alias("_whole"))
    return rows.without(kept, repeated).union(wordless.select("_whole.*")).union(single.select("_whole.*"))

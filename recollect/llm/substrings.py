"""Suffix-array dedup (9): bytes covered by a string of `LENGTH` bytes that also starts earlier are removed.

Texts are UTF-8 bytes; matches don't cross documents; the order is by doc_id, then a hash of the text, then place. All
is judged on the input, so overlapping matches count.

1. Equal texts are one text: its first document is looked at, in the others every byte goes (if there are `LENGTH`).
2. Every string of `LENGTH` bytes has an anchor: its substring of `ANCHOR` bytes with the smallest hash, the first of equal ones.
   The choice depends on the string only, so equal strings have equal anchors at equal offsets. An anchor serves a row of strings that
   start up to `LENGTH - ANCHOR` bytes in front of it. Only anchors whose hash occurs twice in all texts go on.
3. The suffixes at these anchors are sorted, as far as their strings reach: a sparse suffix array, range-partitioned, with what lies
   in front of each anchor beside it (`suffix_array.sorted_suffixes`).
4. A string that starts d bytes in front of its anchor equals another if the suffixes share `LENGTH` - d bytes, which by the common
   prefixes of neighbours is a stretch of the array, and the d bytes in front are equal, a stretch of the array of the reversed fronts.
   In each class of equal strings all but the first are starts of removed ones. A task takes `ROWS` suffixes at a time.
   Strings whose stretch may go on beyond these are left open: one for each class goes on, and they are
   compared by 128-bit fingerprints over all tasks. So an anchor of any number of places is split, not held.
5. The removed runs go back to their documents.

Cases: null or empty texts and texts under `LENGTH` bytes lose nothing. Rows equal in id and text are one document, each of them
loses the same. Null ids come first. An empty table gives an empty result. Texts that are cut inside a
character are kept as bytes.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import flat, rows, suffix_array
from recollect.llm.suffix_array import _batch
from recollect.operators.skew import join_lookup
from recollect.session import cut_and_free, cut_lineage

LENGTH = 100
ANCHOR = 40
REACH = LENGTH - ANCHOR

# The place of an anchor is told by the low bits of its hash, so texts are looked at in pieces of fewer bytes.
LOW = np.uint64((1 << 20) - 1)
PIECE = 1 << 19
CUT = 1 << 14


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of values[i:i+width], for all i that have so many."""
    have = 1
    out = values
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[:len(values) - width + 1], out[width - have:][:len(values) - width + 1])


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of some texts, one after the other in `data`: text number, place in it, the nearest and the farthest start
    in front of it of the strings it serves, and its hash. An anchor may come twice, with other strings."""
    found = []
    for begin in range(0, len(data) - LENGTH + 1, PIECE):
        own = data[begin:begin + PIECE + LENGTH - 1]
        places = np.arange(len(own) - ANCHOR + 1)
        hashes = flat.run_hashes(own, places, places + ANCHOR)
        least = _sliding((hashes & ~LOW) | places.astype(np.uint64), REACH + 1, np.minimum)
        chosen = (least & LOW).astype(np.int64)
        of = np.searchsorted(at, np.arange(begin, begin + len(chosen)), side="right") - 1
        start = np.flatnonzero(np.arange(begin, begin + len(chosen)) + LENGTH <= at[of + 1])
        if len(start):
            chosen, of = chosen[start], of[start]
            first = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
            last = np.append(first[1:], len(start)) - 1
            place = chosen[first]
            found.append((of[first], place + begin - at[of[first]], place - start[last], place - start[first], hashes[place].view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 5


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text of `LENGTH` bytes or more."""
    _, place, _, _, hashes = windows(data, np.array([0, len(data)]))
    return place, hashes


def _distinct(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of texts that equal an earlier one (md5), and the other texts that are long enough, once each."""
    told = rows.keyed(docs).where(F.octet_length("text") >= LENGTH)
    keys = told.select("id", "tag", F.md5(F.col("text").cast("binary")).alias("digest"))
    first = cut_lineage(keys.groupBy("digest").agg(F.min(F.struct("id", "tag")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    same = cut_and_free(keys.join(first, "digest").withColumn("copy", F.struct("id", "tag") != F.col("f")).groupBy("id", "tag").agg(
        F.max("copy").alias("copy"), F.count(F.lit(1)).alias("n")))
    copies = cut_lineage(same.where("copy").select("id", "tag"))
    texts = join_lookup(told, copies, ["id", "tag"], "left_anti")
    # rows of a table that come twice as they are
    twice = cut_lineage(same.where("not copy and n > 1").select("id", "tag"))
    if not twice.isEmpty():
        once = join_lookup(texts, twice, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"])
        texts = join_lookup(texts, twice, ["id", "tag"], "left_anti").union(once)
    return copies, texts


SUFFIXES = "id long, tag long, spot long, front binary, suffix binary"


def suffixes(texts: DataFrame) -> DataFrame:
    """(id, tag, spot, front, suffix): repeated anchors of distinct texts (id, tag, text) with the bytes from the anchor on and
    the reversed ones in front of it, as far as its strings reach. `spot` tells place, nearest and farthest start of these."""
    def mark(batches):
        for batch in batches:
            for part in flat.slices(batch):
                of, place, near, far, hashes = windows(*flat.flatten(part.column("text")))
                who = pa.array(of)
                yield _batch(id=part.column("id").take(who), tag=part.column("tag").take(who), hash=hashes, spot=(place << 12) | (near << 6) | far)

    def cut(batches):
        for batch in batches:
            for part in flat.slices(batch):
                data, at = flat.flatten(part.column("text"))
                spots = part.column("spots")
                spot = spots.flatten().to_numpy()
                of = np.repeat(np.arange(len(spots)), np.diff(spots.offsets.to_numpy()))
                for few in np.array_split(np.arange(len(spot)), len(spot) // CUT + 1):
                    s, who = spot[few], pa.array(of[few])
                    place, near, far = at[of[few]] + (s >> 12), s >> 6 & 63, s & 63
                    back = flat.spread(-place + 1, far)
                    yield _batch(id=part.column("id").take(who), tag=part.column("tag").take(who), spot=s,
                                 front=_strings(data[-back], far), suffix=_strings(data[flat.spread(place, LENGTH - near)], LENGTH - near))

    marks = texts.mapInArrow(mark, "id long, tag long, hash long, spot long")
    counts = marks.select("hash").groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    twice = cut_and_free(counts.where("n > 1").select("hash"))
    spots = cut_and_free(marks.join(twice, "hash").groupBy("id", "tag").agg(F.collect_list("spot").alias("spots")))
    return cut_and_free(texts.join(spots, ["id", "tag"]).select("id", "tag", "text", "spots").mapInArrow(cut, SUFFIXES))


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _classes(part: pa.Table, before: int, behind: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes, by row and distance of the start in front of the anchor: which strings start earlier too, and which first
    ones may have equals outside, where `before` and `behind` bytes are shared with the rows there at most."""
    n = part.num_rows
    spot = part["spot"].to_numpy()
    near, far = spot >> 6 & 63, spot & 63
    rank = np.empty(n, np.int64)
    rank[np.lexsort((spot, part["tag"].to_numpy(), part["id"].to_numpy()))] = np.arange(n)
    row_of = np.argsort(rank)
    shared = suffix_array.shared(*suffix_array.padded(part["suffix"], LENGTH))
    by_front, front_shared = suffix_array.sorted_rows(*suffix_array.padded(part["front"], REACH))
    later, open_ = np.zeros((n, REACH + 1), bool), np.zeros((n, REACH + 1), bool)
    front = np.empty(n, np.int64)
    for d in range(REACH + 1):
        begins = np.concatenate([[True], shared < LENGTH - d])
        stretch = np.cumsum(begins) - 1
        front[by_front] = np.cumsum(np.concatenate([[0], front_shared < d]))
        edge = np.zeros(n, bool)
        if before >= LENGTH - d:
            edge |= stretch == 0
        if behind >= LENGTH - d:
            edge |= stretch == stretch[-1]
        alone = begins & np.append(begins[1:], True)
        some = np.flatnonzero((near <= d) & (d <= far) & (~alone | edge))
        told = np.sort((stretch[some] * n + front[some]) * n + rank[some])
        if len(told):
            row = row_of[told % n]
            first = np.concatenate([[True], told[1:] // n != told[:-1] // n])
            later[row[~first], d] = True
            open_[row[first & edge[row]], d] = True
    return later, open_


STARTS = "id long, tag long, low long, high long, h1 long, h2 long"


def _later_runs(part: pa.Table, later: np.ndarray) -> pa.RecordBatch:
    """Runs of bytes that strings cover which start earlier too."""
    edges = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, near = np.nonzero(edges == 1)
    far = np.nonzero(edges == -1)[1] - 1
    place = part["spot"].to_numpy()[row] >> 12
    none = pa.nulls(len(row), pa.int64())
    return _batch(id=part["id"].to_numpy()[row], tag=part["tag"].to_numpy()[row], low=place - far, high=place - near + LENGTH, h1=none, h2=none)


def _open_strings(part: pa.Table, open_: np.ndarray):
    """Strings that may have equals elsewhere, with their fingerprints."""
    row, d = np.nonzero(open_)
    for few in np.array_split(np.arange(len(row)), len(row) // CUT + 1):
        r, back = row[few], d[few]
        own, of = np.unique(r, return_inverse=True)
        held = part.select(["front", "suffix"]).take(pa.array(own))
        whole = [f[::-1] + s for f, s in zip(held["front"].to_pylist(), held["suffix"].to_pylist())]
        base = np.cumsum([0] + [len(w) for w in whole])[:-1]
        fronts = np.array([len(f) for f in held["front"].to_pylist()], np.int64)
        data = np.frombuffer(b"".join(whole), np.uint8)
        start = (base + fronts)[of] - back if len(own) else back
        h1, h2 = (flat.run_hashes(data, start, start + LENGTH, seed).view(np.int64) for seed in (0, 1))
        low = (part["spot"].to_numpy()[r] >> 12) - back
        yield _batch(id=part["id"].to_numpy()[r], tag=part["tag"].to_numpy()[r], low=low, high=low + LENGTH, h1=h1, h2=h2)


def later_runs(found: DataFrame) -> DataFrame:
    """(id, tag, low, high): runs of bytes covered by strings that start earlier too."""
    size = suffix_array.ROWS

    def run(batches):
        for part, before, behind in suffix_array.stretches(batches, LENGTH, size):
            later, open_ = _classes(part, before, behind)
            yield _later_runs(part, later)
            yield from _open_strings(part, open_)

    told = cut_and_free(suffix_array.sorted_suffixes(found, ["id", "tag", "spot"]).mapInArrow(run, STARTS))
    edge = told.where("h1 is not null")
    start = F.struct("id", "tag", "low")
    first = cut_lineage(edge.groupBy("h1", "h2").agg(F.min(start).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    columns = ["id", "tag", "low", "high"]
    return told.where("h1 is null").select(columns).union(edge.join(first, ["h1", "h2"]).where(start > F.col("first")).select(columns))


def repeated(docs: DataFrame) -> DataFrame:
    """(id, tag, copy, gone): for texts that lose bytes, whether all go, else the runs (low, high), which may overlap."""
    copies, texts = _distinct(docs)
    runs = later_runs(suffixes(texts)).groupBy("id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    whole = copies.withColumns({"copy": F.lit(True), "gone": F.array().cast("array<struct<low:long,high:long>>")})
    return whole.union(runs.select("id", "tag", F.lit(False).alias("copy"), "gone"))


def kept(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary)."""
    def run(batches):
        for batch in batches:
            for part in flat.slices(batch):
                data, at = flat.flatten(part.column("text"))
                made = []
                for k, (copy, gone) in enumerate(zip(part.column("copy").to_pylist(), part.column("gone").to_pylist())):
                    own = data[at[k]:at[k + 1]]
                    cover = np.zeros(len(own) + 1, np.int64)
                    if copy:
                        cover[0] = 1
                    elif gone:
                        np.add.at(cover, [g["low"] for g in gone], 1)
                        np.add.at(cover, [g["high"] for g in gone], -1)
                    out = np.cumsum(cover)[:-1] > 0
                    spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
                    made.append((len(own), int(out.sum()), spans, own[~out].tobytes()))
                columns = [pa.array([m[i] for m in made], pa.int64()) for i in range(3)] + [pa.array([m[3] for m in made], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    told = rows.keyed(docs).join(cut_and_free(repeated(docs)), ["id", "tag"], "left").select("id", "text", "copy", "gone")
    return told.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary").select(
        rows.real_id(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def digests(docs: DataFrame) -> DataFrame:
    return kept(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Ranks of all suffixes of a very long text: the difference-cover algorithm of three (DC3), by Spark sorts.

A text is a table of blocks (block, values: binary, 64-bit numbers) of `BLOCK` symbols each; position p stands in block
p // BLOCK. Symbols are positive, only the last three or more are 0, and the length is a multiple of three. A step of the recursion

1. sorts the triples at positions that are 1 or 2 modulo 3 and names them in order;
2. unless all names differ, ranks the string of names (first those at 1, then those at 2 modulo 3) by itself;
3. merges the remaining suffixes: those at 0 and 1 modulo 3 compare by their first symbol and the rank of what
   follows, those at 0 and 2 by two symbols and the rank behind them. Two sorts with running
   counts tell for every suffix how many of the other kind come before it.

Sorts are range-partitioned; counts and names are local to a task first, and only one row for each task goes to the driver.
A string of `LOCAL` symbols or fewer is sorted by one task, whatever the size of the input: that is the end of the recursion.

Below it stands a sparse suffix array, of chosen suffixes as far as they are given, which one sort puts in order: `sorted_suffixes`,
and for the rows of a task `stretches`, `padded` and `shared` (common prefixes of neighbours).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import cut_lineage

BLOCK = 3 << 15
LOCAL = 1 << 20

BLOCKS = "block long, values binary"


def _sequence(batches, names):
    """The rows of a partition, some at a time, as arrays."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def to_blocks(values: DataFrame, n: int) -> DataFrame:
    """Blocks of a text of n symbols from rows (pos, value); equal positions add up, missing ones are 0."""
    size = BLOCK

    def run(batches):
        block, held = None, None
        for pos, value in _sequence(batches, ("pos", "value")):
            blocks = pos // size
            for b in np.unique(blocks):
                if b != block:
                    if held is not None:
                        yield _batch(block=np.array([block]), values=pa.array([held.tobytes()], pa.binary()))
                    block, held = b, np.zeros(min(size, n - b * size), np.int64)
                own = blocks == b
                np.add.at(held, pos[own] - b * size, value[own])
        if held is not None:
            yield _batch(block=np.array([block]), values=pa.array([held.tobytes()], pa.binary()))

    block = F.floor(F.col("pos") / size)
    return values.select("pos", "value").repartition(block).sortWithinPartitions(block).mapInArrow(run, BLOCKS)


def with_ahead(blocks: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """Each block with the first `n` symbols of the next one (zeros behind the last) after its own."""
    heads = blocks.select((F.col("block") - 1).alias("block"), *[F.substring(c, 1, 8 * n).alias(f"{c}_ahead") for c in columns])
    joined = blocks.join(heads, "block", "left")
    longer = lambda c: F.concat(c, F.coalesce(f"{c}_ahead", F.lit(b"")), F.lit(bytes(8 * n)))
    return joined.select("block", *[F.substr(longer(c), F.lit(1), F.octet_length(c) + 8 * n).alias(c) for c in columns])


def _each_block(batches, columns):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("block")[k].as_py(), *(np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in columns)


def _offsets(local: DataFrame, counts: list[str]) -> tuple[DataFrame, list[int]]:
    """For each task what the tasks before it counted; `counts` are columns that only grow within a task. And the totals."""
    got = sorted(local.groupBy("part").agg(*[F.max(c).alias(c) for c in counts]).collect())
    sums = np.cumsum([[0] * len(counts)] + [list(r[1:]) for r in got], axis=0)
    rows = [(r[0], *map(int, s)) for r, s in zip(got, sums)]
    schema = "part int, " + ", ".join(f"{c}_before long" for c in counts)
    return F.broadcast(local.sparkSession.createDataFrame(rows, schema)), [int(x) for x in sums[-1]]


def _named(triples: DataFrame) -> tuple[DataFrame, bool]:
    """(pos, value): names from 1 for the sampled triples, in their order; and whether all differ."""
    keys = ["c0", "c1", "c2", "z"]

    def run(batches):
        from pyspark import TaskContext

        part, last, name, rows = TaskContext.get().partitionId(), None, 0, 0
        for *key, pos in _sequence(batches, [*keys, "pos"]):
            key = np.stack(key, axis=1)
            new = np.ones(len(pos), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            if last is not None:
                new[0] = (key[0] != last).any()
            names = name + np.cumsum(new)
            counted = rows + np.arange(1, len(pos) + 1)
            last, name, rows = key[-1], int(names[-1]), rows + len(pos)
            yield _batch(pos=pos, local=names, row=counted, part=np.full(len(pos), part, np.int32))

    ordered = triples.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = cut_lineage(ordered.mapInArrow(run, "pos long, local long, row long, part int"))
    before, (names, rows) = _offsets(local, ["local", "row"])
    return local.join(before, "part").select("pos", (F.col("local") + F.col("local_before")).alias("value")), names == rows


def _triples(blocks: DataFrame) -> DataFrame:
    """Sampled positions with their three symbols; the zeros at the end are told apart, the shorter rest first."""
    size = BLOCK

    def run(batches):
        for b, v in _each_block(batches, ["values"]):
            n = len(v) - 2
            at = np.flatnonzero(np.arange(n) % 3)
            pos = b * size + at
            yield _batch(pos=pos, c0=v[at], c1=v[at + 1], c2=v[at + 2], z=np.where(v[at] == 0, -pos, 0))

    return with_ahead(blocks, 2, ["values"]).mapInArrow(run, "pos long, c0 long, c1 long, c2 long, z long")


def local_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of a short text, by doubling."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    step = 1
    while rank.max(initial=0) < n - 1:
        after = np.zeros(n, np.int64)
        after[:max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def _ranked_in_one_task(blocks: DataFrame) -> DataFrame:
    def run(batches):
        parts = sorted((b, v) for b, v in ((b, v) for b, v in _each_block(batches, ["values"])))
        values = np.concatenate([v for _, v in parts])
        yield _batch(pos=np.arange(len(values)), value=local_ranks(values))

    return blocks.repartition(1).mapInArrow(run, "pos long, value long")


def _merged(blocks: DataFrame) -> DataFrame:
    """(pos, value): how many suffixes come before each, from blocks with `values` and the ranks (from 1, 0 at multiples
    of three) of the sampled suffixes in `ranks`. Parts of a number are rows of their own."""
    size = BLOCK
    ahead = cut_lineage(with_ahead(blocks, 2, ["values", "ranks"]))

    def by(other: int):
        def run(batches):
            for b, v, r in _each_block(batches, ["values", "ranks"]):
                k = np.arange(len(v) - 2)
                at = k[(k % 3 == 0) | (k % 3 == other)]
                second = v[at + 1] if other == 2 else np.zeros(len(at), np.int64)
                yield _batch(pos=b * size + at, own=r[at], c0=v[at], c1=second, rest=r[at + other])

        return run

    def count(other: int):
        def run(batches):
            from pyspark import TaskContext

            part, zeros, others = TaskContext.get().partitionId(), 0, 0
            for pos, own in _sequence(batches, ["pos", "own"]):
                zero = pos % 3 == 0
                z, o = zeros + np.cumsum(zero), others + np.cumsum(~zero)
                yield _batch(pos=pos, own=own, zeros=z, others=o, part=np.full(len(pos), part, np.int32))
                zeros, others = int(z[-1]), int(o[-1])

        return run

    out = None
    for other in (1, 2):
        keys = ["c0", "c1", "rest"]
        rows = ahead.mapInArrow(by(other), "pos long, own long, c0 long, c1 long, rest long")
        ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("pos", "own")
        local = cut_lineage(ordered.mapInArrow(count(other), "pos long, own long, zeros long, others long, part int"))
        before, _ = _offsets(local, ["zeros", "others"])
        zeros, others = F.col("zeros") + F.col("zeros_before"), F.col("others") + F.col("others_before")
        # the others' own rank counts the sampled ones, this sort the ones at multiples of three
        of_zero = others + (zeros - 1 if other == 1 else 0)
        part = local.join(before, "part").select("pos", F.when(F.col("pos") % 3 == 0, of_zero).otherwise(F.col("own") - 1 + zeros).alias("value"))
        out = part if out is None else out.union(part)
    return out


def _numbered(blocks: DataFrame, alphabet: int) -> DataFrame:
    """(pos, value): the sampled triples of a small alphabet as numbers, which are in order without a sort."""
    size = BLOCK

    def run(batches):
        for b, v in _each_block(batches, ["values"]):
            at = np.flatnonzero(np.arange(len(v) - 2) % 3)
            yield _batch(pos=b * size + at, value=(v[at] * alphabet + v[at + 1]) * alphabet + v[at + 2] + 1)

    return with_ahead(blocks, 2, ["values"]).mapInArrow(run, "pos long, value long")


def suffix_ranks(blocks: DataFrame, n: int, alphabet: int = 0) -> DataFrame:
    """Blocks of the ranks (from 0) of all n suffixes. With `alphabet` symbols (a few hundred) the first names are
    told by counting, not by sorting."""
    if n <= LOCAL:
        return cut_lineage(to_blocks(_ranked_in_one_task(blocks), n))
    names, different = (_numbered(blocks, alphabet), False) if alphabet else _named(_triples(blocks))
    if not different:
        third = n // 3
        index = F.floor(F.col("pos") / 3) + F.when(F.col("pos") % 3 == 2, third).otherwise(0)
        m = (2 * third + 3 + 2) // 3 * 3
        ends = blocks.sparkSession.range(2 * third, m).select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("value"))
        string = cut_lineage(to_blocks(names.select(index.cast("long").alias("pos"), "value").union(ends), m))
        ranks = suffix_ranks(string, m)
        names = _sampled(ranks, third, m)
    sampled = names.union(blocks.select((F.col("block") * BLOCK).alias("pos"), F.lit(0).cast("long").alias("value")))
    both = blocks.join(to_blocks(sampled, n).select("block", F.col("values").alias("ranks")), "block")
    return cut_lineage(to_blocks(_merged(both), n))


def _sampled(ranks: DataFrame, third: int, m: int) -> DataFrame:
    """(pos, value): the ranks of the string of names, from 1 without the zeros at its end, back at their positions."""
    size, extra = BLOCK, m - 2 * third

    def run(batches):
        for b, r in _each_block(batches, ["values"]):
            q = b * size + np.arange(len(r))
            some = q < 2 * third
            q, r = q[some], r[some]
            second = q >= third
            yield _batch(pos=np.where(second, 3 * (q - third) + 2, 3 * q + 1), value=r - extra + 1)

    return ranks.mapInArrow(run, "pos long, value long")


# Suffixes that a task looks at side by side, up to twice as many.
ROWS = 1 << 16


def sorted_suffixes(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """A sparse suffix array: rows in the order of `suffix` (binary), equal ones in the order of `keys`, over all tasks."""
    order = ["suffix", *keys]
    return suffixes.repartitionByRange(*order).sortWithinPartitions(*order)


def stretches(batches, most: int, size: int):
    """The sorted rows of a task, `size` or up to twice as many at a time, as tables, with the number of bytes (`most` if unknown) that the first suffix shares with
    the one before it and the last with the one behind it. Cuts are where neighbours share the least."""
    held, before = None, most
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        while held.num_rows >= 2 * size:
            common = shared(*padded(held["suffix"][size - 1:2 * size], most))
            k = int(np.argmin(common))
            yield held[:size + k], before, int(common[k])
            held, before = held[size + k:], int(common[k])
    if held is not None:
        yield held, before, most


def padded(strings: pa.ChunkedArray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of a matrix, filled up with zeros to whole words, and their lengths."""
    whole = pa.concat_arrays([c.cast(pa.large_binary()) for c in strings.chunks])
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    sizes = np.diff(at)
    out = np.zeros((len(whole), (most + 7) // 8 * 8), np.uint8)
    if at[-1] > at[0]:
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    return out, sizes


def shared(strings: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many bytes each string has in common with the next one."""
    differ = strings[1:] != strings[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def sorted_rows(strings: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the order of the strings, and what neighbours have in common."""
    words = strings.view(">u8").astype(np.uint64)
    order = np.lexsort((sizes, *words.T[::-1]))
    return order, shared(strings[order], sizes[order])

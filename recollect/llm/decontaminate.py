"""Benchmark decontamination (2): SimHash of item-sized windows, Hamming blocks, exact verification.

Words are letters, digits and non-ASCII signs with A-Z lowered; punctuation and line ends don't count. An item of m words
is compared with windows of m words of a document by their shingles of five words (m, if fewer). A shingle
weighs as many bytes as its words have, once for each time it occurs; the similarity is the weighted Jaccard
similarity, and a window with 0.8 or more is a hit. A document of fewer words than the item is a single window, all of it.

1. Windows that share no shingle with an item of their size can't reach any similarity; all others get a
   SimHash of `BITS` bits from the weighted shingles. Running sums give all windows of one size at once.
2. Fingerprints are cut into `BLOCKS` blocks. If two of them differ in `RADIUS` bits at most, some block differs in
   RADIUS // BLOCKS at most; the items are listed under all such keys, so that looking up each block of a
   window finds every item within the radius. At similarity 0.8 the expected distance is 15 % of the bits;
   `RADIUS` lies more than six standard deviations above.
3. Candidates are verified on the shingles themselves.

The items are a stated query set: they are taken in blocks of about `ITEM_BYTES` of text, each broadcast and run
against all documents in a pass without a shuffle.

Cases: null or empty texts and texts without words have no hit; items without words never hit. Items of
fewer than five words hit where their words stand; a document with fewer words than a shingle of the item shares none. Rows with a null id are searched as well, repeated
rows each give their own hits, items with equal texts are all reported. Of several windows of a
document for one item the most similar counts, of equals the first. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import flat

WIDTH = 5
THRESHOLD = 0.8
BITS, BLOCKS, RADIUS = 128, 16, 47
ITEM_BYTES = 4 << 20

HITS = ("doc_id long, item_id long, similarity double, first_word long, last_word long, start long, end long, "
        "n_windows long")


class Words:
    """Words of some texts: hashes, byte lengths (as running sum), owner and span of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = flat.lower_ascii(data)
        self.starts, self.ends, self.of = flat.letter_words(data, at)
        self.hashes = flat.run_hashes(data, self.starts, self.ends)
        self.sizes = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        counts = np.bincount(self.of, minlength=len(at) - 1)
        self.stops = np.cumsum(counts)
        self.begins = self.stops - counts

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and weight of the shingle at each word; those that cross texts are there as well."""
        hashes = flat.window_hashes(self.hashes, width, seed=width)
        return hashes, (self.sizes[width:] - self.sizes[:-width])[:len(hashes)] if len(hashes) else np.zeros(0, np.int64)


def signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(n, BITS) weights with the sign of each hash bit."""
    words = np.stack([flat.mix(hashes + np.uint64(17 * k + 1)) for k in range(BITS // 64)], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(hashes), -1), axis=1)
    return np.where(bits, weights[:, None], -weights[:, None]).astype(np.int32)


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a matrix its hashes, sorted, the k-th repetition of a value marked with k; and the
    order that sorted them."""
    order = np.argsort(hashes, axis=1, kind="stable")
    values = np.take_along_axis(hashes, order, axis=1)
    run = np.zeros(values.shape, np.int64)
    for k in range(1, values.shape[1]):
        run[:, k] = np.where(values[:, k] == values[:, k - 1], run[:, k - 1] + 1, 0)
    return flat.mix(values + run.astype(np.uint64) * np.uint64(flat.BASE)), order


class Items:
    """The items of one number of words: shingles, fingerprints and the index of their blocks."""

    def __init__(self, number: np.ndarray, size: int, hashes: np.ndarray, weights: np.ndarray):
        self.number, self.size, self.width = number, size, min(WIDTH, size)
        self.known = np.unique(hashes)
        sums = np.stack([signs(h, w).sum(axis=0) for h, w in zip(hashes, weights)])
        self.prints = np.packbits(sums > 0, axis=1)
        self.total = weights.sum(axis=1)
        marked, _ = numbered(hashes)
        self.marked = np.sort((marked ^ flat.mix(np.arange(len(number), dtype=np.uint64))[:, None]).ravel())
        flips = [sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(BITS // BLOCKS), n)]
        keys = (self.prints[:, :, None] ^ np.array(flips, np.uint8)).astype(np.int64) + (np.arange(BLOCKS) << 8)[None, :, None]
        keys, items = keys.ravel(), np.repeat(np.arange(len(number)), BLOCKS * len(flips))
        order = np.argsort(keys, kind="stable")
        self.listed = items[order]
        self.at = np.searchsorted(keys[order], np.arange((BLOCKS << 8) + 1))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (fingerprint, item) that differ in RADIUS bits at most."""
        keys = (prints.astype(np.int64) + (np.arange(BLOCKS) << 8)).ravel()
        counts = self.at[keys + 1] - self.at[keys]
        items = self.listed[flat.spread(self.at[keys], counts)]
        who = np.repeat(np.repeat(np.arange(len(prints)), BLOCKS), counts)
        pairs = np.unique(who * len(self.number) + items)
        who, items = pairs // len(self.number), pairs % len(self.number)
        near = np.bitwise_count(prints[who] ^ self.prints[items]).sum(axis=1) <= RADIUS
        return who[near], items[near]

    def similarity(self, hashes: np.ndarray, weights: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of each row of shingles with its item."""
        marked, order = numbered(hashes)
        weights = np.take_along_axis(weights, order, axis=1)
        keys = marked ^ flat.mix(items.astype(np.uint64))[:, None]
        found = self.marked[np.minimum(np.searchsorted(self.marked, keys), len(self.marked) - 1)] == keys
        shared = (weights * found).sum(axis=1)
        return shared / (weights.sum(axis=1) + self.total[items] - shared)


def index(texts: list[str | None]) -> list[Items]:
    data, at = flat.flatten(pa.array(texts, pa.string()))
    words = Words(data, at)
    counts = words.stops - words.begins
    out = []
    for size in np.unique(counts[counts > 0]):
        number = np.flatnonzero(counts == size)
        hashes, weights = words.shingles(min(WIDTH, size))
        at_ = words.begins[number][:, None] + np.arange(size - min(WIDTH, size) + 1)
        out.append(Items(number, int(size), hashes[at_], weights[at_]))
    return out


def search(words: Words, groups: list[Items]):
    """(text, item number, similarity, first word in the slice, windows that hit) of the best windows."""
    found = []
    for width in {g.width for g in groups}:
        hashes, weights = words.shingles(width)
        if not len(hashes):
            continue
        known = np.unique(np.concatenate([g.known for g in groups if g.width == width]))
        inside = words.of[:len(hashes)] == words.of[width - 1:]
        some = np.flatnonzero(inside & (known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes))
        for g in groups if len(some) else ():
            if g.width != width:
                continue
            hit = some[np.isin(hashes[some], g.known)]
            last = words.stops[words.of[hit]] - g.size  # the last window that ends inside the text
            low, high = np.maximum(hit - (g.size - width), words.begins[words.of[hit]]), np.minimum(hit, last)
            texts = np.unique(words.of[hit[last < words.begins[words.of[hit]]]])  # shorter than the item
            low, high = low[low <= high], high[low <= high]
            sets = [(np.unique(flat.spread(low, high - low + 1)), g.size)] if len(low) else []
            counts = words.stops[texts] - words.begins[texts]
            sets += [(words.begins[texts[counts == n]], int(n)) for n in np.unique(counts)]
            for windows, size in sets:
                who, items, similar = _windows(g, hashes, weights, windows, size - width + 1)
                on = similar >= THRESHOLD - 1e-12
                found.append((words.of[windows[who[on]]], g.number[items[on]], similar[on], windows[who[on]], np.full(on.sum(), size)))
    if not found:
        return None
    text, item, similar, first, size = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((first, -similar, item, text))
    text, item, similar, first, size = text[order], item[order], similar[order], first[order], size[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    n = np.diff(np.concatenate([np.flatnonzero(new), [len(text)]]))
    return text[new], item[new], similar[new], first[new], size[new], n


def _windows(g: Items, hashes, weights, windows, n, chunk: int = 20_000):
    """Pairs of windows and items within the radius, with their similarity."""
    parts = []
    for a in range(0, len(windows), chunk):
        own = windows[a:a + chunk]
        needed = np.unique(flat.spread(own, np.full(len(own), n)))
        sums = np.zeros((len(needed) + 1, BITS), np.int64)
        np.cumsum(signs(hashes[needed], weights[needed]), axis=0, out=sums[1:])
        k = np.searchsorted(needed, own)
        who, items = g.within(np.packbits(sums[k + n] - sums[k] > 0, axis=1))
        at = own[who][:, None] + np.arange(n)
        parts.append((who + a, items, g.similarity(hashes[at], weights[at], items)))
    return [np.concatenate(x) for x in zip(*parts)]


def _item_blocks(items: DataFrame) -> list:
    """The items, as (ids, texts), in blocks of bounded size; their number follows from the measured size."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // ITEM_BYTES) or 1
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toArrow()
        yield got.column("item_id").to_pylist(), got.column("text").to_pylist()


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, similarity, first_word, last_word, start, end, n_windows): for each document and item
    with a hit the best window, in words and in code points (end exclusive), and the number of windows that hit."""
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for ids, texts in _item_blocks(items):
        held = docs.sparkSession.sparkContext.broadcast((ids, index(texts)))
        part = told.mapInArrow(_finder(held), HITS)
        out = part if out is None else out.union(part)
    return out


def _finder(held):
    def run(batches):
        ids, groups = held.value
        for batch in batches:
            for part in flat.slices(batch):
                data, at = flat.flatten(part.column("text"))
                words = Words(data, at)
                got = search(words, groups)
                if got is None:
                    continue
                text, item, similar, first, size, n = got
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin = words.begins[text]
                own = points[at[text]]
                columns = [part.column("doc_id").take(pa.array(text)), pa.array([ids[i] for i in item], pa.int64()), similar,
                           first - begin, first - begin + size - 1, points[words.starts[first]] - own,
                           points[words.ends[first + size - 1]] - own, n]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                                                 names=[c.split()[0] for c in HITS.split(", ")])

    return run


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` without any hit, all columns as they are; one pass over them for each block of items."""
    for _, texts in _item_blocks(items):
        held = docs.sparkSession.sparkContext.broadcast(index(texts))
        told = docs.select(F.struct("*").alias("_whole"))
        docs = told.mapInArrow(_dropper(held), told.schema).select("_whole.*")
    return docs


def _dropper(held):
    def run(batches):
        for batch in batches:
            for part in flat.slices(flat.with_text(batch)):
                got = search(Words(*flat.flatten(part.column("text"))), held.value)
                keep = np.ones(part.num_rows, bool)
                if got is not None:
                    keep[got[0]] = False
                yield part.select(["_whole"]).filter(pa.array(keep))

    return run

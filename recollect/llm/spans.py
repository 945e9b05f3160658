"""Substring dedup (7): sliding sentence spans.

A sentence is a row of words ([^\\x20\\x09-\\x0D]+) up to a word that ends in ".", "!" or "?", to a line end or to the end of the
text; its content are the bytes from its first to its last word. From every sentence of a text a span goes on, and to every
sentence one leads up, over at least `LEAST` sentences and `WORDS` words, as few as that takes, so equal passages give equal spans
wherever they stand, and a few short sentences alone give none. A passage of so many whole sentences and words is
covered by its spans without a rest: up to where the one from its first sentence ends, from where the one to its last
sentence begins, and between these by those that lead up to each sentence. A sentence of `LONG` words is a span of its own, and so
is a text of a single sentence of `WORDS` words, which has equals among such texts only. Spans are hashed to 128 bits and counted over all
documents; of a repeated span the occurrence first by (doc_id, hash of the text, sentence) stays, and every
sentence that any other occurrence covers is removed, with the blanks behind it.

That is the `wide` rule, which the query takes. Without it spans only go on, over `SENTENCES` sentences and `WORDS` words.

Spans that occur once leave after the first aggregation, which sums up in each task before the shuffle; a span that a third of all documents
share is one row of each task there, and its occurrences are split by adaptive skew joins afterwards.

Cases: null or empty texts and texts too short for a span lose nothing. Rows equal in id and text are one document: no copy removes
the other, and each loses the same. Rows equal in id only are ordered by a hash of the text; null ids come first. An empty
table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import flat, rows
from recollect.session import cut_lineage

SENTENCES, WORDS = 3, 15
LEAST, LONG = 2, 51
STOPS = b".!?"

SPANS = "id long, tag long, h1 long, h2 long, first int, last int"


class Sentences:
    """Sentences of some texts: byte spans, owner, number within the text, and words before each."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        starts, ends, of = flat.blank_words(data, at)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        last = flat.member(STOPS)[data[ends - 1]] if len(ends) else np.zeros(0, bool)
        if len(ends):
            last[:-1] |= (of[1:] != of[:-1]) | (lines[starts[1:]] > lines[ends[:-1]])
            last[-1] = True
        closing = np.flatnonzero(last)
        opening = np.concatenate([[0], closing[:-1] + 1]) if len(closing) else closing
        self.starts, self.ends, self.of = starts[opening], ends[closing], of[closing]
        self.words = np.concatenate([opening, [len(starts)]]) if len(closing) else np.zeros(1, np.int64)
        counts = np.bincount(self.of, minlength=len(at) - 1)
        self.stops = np.cumsum(counts)
        self.begins = self.stops - counts

    def spans(self, data: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last (exclusive) sentence of every span, and two hashes of each."""
        n = len(self.of)
        first, last = self._wide() if wide else self._onward(SENTENCES)
        hashes = []
        for seed in (0, 1):
            own = flat.run_hashes(data, self.starts, self.ends, seed)
            base = 0xD1342543DE82EF95 + 8 * seed
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * flat.powers(base, n))])
            back = flat.powers(pow(base, -1, 1 << 64), n)
            hashes.append(flat.mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)))
        return first, last, hashes[0], hashes[1]

    def _onward(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The span that goes on from each sentence, as far as the text has one."""
        first = np.arange(len(self.of))
        last = np.maximum(first + least, np.searchsorted(self.words, self.words[:-1] + WORDS))
        some = last <= self.stops[self.of]
        return first[some], last[some]

    def _wide(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans from and to each sentence and single long sentences, each once."""
        at = np.arange(len(self.of))
        start = np.minimum(at + 1 - LEAST, np.searchsorted(self.words, self.words[1:] - WORDS, side="right") - 1)
        some = start >= self.begins[self.of]
        size = np.diff(self.words)
        only = self.stops[self.of] - self.begins[self.of] < LEAST
        alone = (size >= LONG) | (only & (size >= WORDS))
        first, last = self._onward(LEAST)
        pairs = np.unique(np.concatenate([first, start[some], at[alone]]) * (len(at) + 1)
                          + np.concatenate([last, at[some] + 1, at[alone] + 1]))
        return pairs // (len(at) + 1), pairs % (len(at) + 1)


def hashed(docs: DataFrame, wide: bool = False) -> DataFrame:
    """A row for each span: key of the document, hashes, first and last (exclusive) sentence."""
    def run(batches):
        for batch in batches:
            for part in flat.slices(batch):
                data, at = flat.flatten(part.column("text"))
                s = Sentences(data, at)
                first, last, h1, h2 = s.spans(data, wide)
                own = s.of[first]
                who = pa.array(own)
                begin = s.begins[own]
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(who), part.column("tag").take(who), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32))],
                    names=["id", "tag", "h1", "h2", "first", "last"])

    return rows.keyed(docs).mapInArrow(run, SPANS)


def repeated(docs: DataFrame, wide: bool = False) -> DataFrame:
    """For each document (id, tag) that loses sentences the spans (first, last) that it isn't the first to hold."""
    spans = cut_lineage(hashed(docs, wide))
    twice = spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    held = cut_lineage(spans.join(cut_lineage(twice), ["h1", "h2"]))
    first = held.groupBy("h1", "h2").agg(F.min(F.struct("id", "tag", "first")).alias("kept"))
    later = held.join(cut_lineage(first), ["h1", "h2"]).where(F.struct("id", "tag", "first") != F.col("kept"))
    return later.groupBy("id", "tag").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("gone"))


def removed(docs: DataFrame, wide: bool = False) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed and kept_text."""
    def run(batches):
        for batch in batches:
            for part in flat.slices(batch):
                data, at = flat.flatten(part.column("text"))
                s = Sentences(data, at)
                gone = np.zeros(len(s.of) + 1, np.int64)
                for k, pairs in enumerate(part.column("gone").to_pylist()):
                    for p in pairs or ():
                        gone[s.begins[k] + p["first"]] += 1
                        gone[s.begins[k] + p["last"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                ends = np.append(s.starts[1:], len(data))  # with the blanks behind
                ends[s.stops[s.stops > s.begins] - 1] = at[1:][s.stops > s.begins]
                cut = np.zeros(len(data) + 1, np.int64)
                cut[s.starts[gone]] += 1
                np.add.at(cut, ends[gone], -1)
                keep = np.cumsum(cut)[:-1] == 0
                sizes = np.concatenate([[0], np.cumsum(keep)])[at]
                kept = data[keep].tobytes()
                made = pa.array([kept[a:b].decode() for a, b in zip(sizes[:-1], sizes[1:])], pa.string())
                n = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(s.stops - s.begins), pa.array(n[s.stops] - n[s.begins]), made],
                    names=["id", "n_sentences", "n_removed", "kept_text"])

    told = rows.keyed(docs).join(cut_lineage(repeated(docs, wide)), ["id", "tag"], "left").select("id", "text", "gone")
    return told.mapInArrow(run, "id long, n_sentences long, n_removed long, kept_text string").select(
        rows.real_id(F.col("id")).alias("doc_id"), "n_sentences", "n_removed", "kept_text")


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed and SHA-256 of the text that is kept, by the wide rule."""
    return removed(docs, wide=True).select("doc_id", "n_sentences", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

"""SentencePiece encoding and decoding (4) for merge-type vocabularies.

A text is cut into symbols (characters); an agenda holds the adjacent pairs whose union is in the vocabulary, ordered
by score and then from the left, and the best pair is joined until none is left. Characters outside the vocabulary
become bytes. No piece of such a vocabulary joins a word to the blank after it or reaches over a line end (checked on loading),
so runs of blanks with the word behind them are units of their own: short units run through their agendas
side by side in numpy, long ones each through a heap. Units met for the first time are checked against
the sentencepiece library in each Arrow batch; a difference raises.

Cases: a null or empty text has the begin and end ids only. Repeated rows, null ids and further columns don't matter;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import flat
from recollect.llm.units import Units, per_text

BLANK = "▁"
UNIT = re.compile(rf"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
ROW_WIDTHS = (4, 8, 12, 16, 24, 40, 64)
UNITS_KEPT = 100_000  # by a Python worker: about 20 MB
SYMBOL = 22  # bits of a symbol id: vocabulary, then characters outside it

ENCODED = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class Vocabulary:
    """Symbols, scores and pairs of a merge-type model."""

    def __init__(self, model: bytes):
        self.library = sp = _load(model)
        n = sp.get_piece_size()
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) for i in range(n)]
        pieces = {sp.id_to_piece(i): i for i in range(n) if not special[i] and not sp.is_unused(i)}
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in pieces) or sp.encode(" a", out_type=str)[0] != 2 * BLANK and sp.encode(
                " a", out_type=str)[:2] != [BLANK, f"{BLANK}a"]:
            raise ValueError("pieces that cross words or lines, or a normalising model, need whole texts")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if len(set(self.bytes)) != 256:
            raise ValueError("the vocabulary has no pieces for bytes")
        self.begin, self.end, self.size = sp.bos_id(), sp.eos_id(), n
        # a character is a symbol in any case; one that is no piece has an id beyond the vocabulary
        self.symbols = {c: n + ord(c) for p in pieces for c in p} | pieces
        keys, merged = [], []
        for piece, k in pieces.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << SYMBOL | right)
                    merged.append(k)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys)[order], np.array(merged, np.int32)[order]
        self.scores = np.append([sp.get_score(i) for i in range(n)], -np.inf)
        self.table = dict(zip(self.keys.tolist(), self.merged.tolist()))
        # symbol of each code point met so far
        self.of_point = np.full(0x110000, -1, np.int32)
        for c, k in self.symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)] = k
        unmet = self.of_point < 0
        self.of_point[unmet] = (n + np.arange(0x110000))[unmet]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Union (or -1) of each pair, and its score."""
        keys = left.astype(np.int64) << SYMBOL | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        union = np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.merged[at], -1)
        return union, self.scores[union]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units and their numbers, checked against the library."""
        sizes = np.array([len(u) for u in units])
        which, ids, counts = [], [], []
        low = 0
        for width in ROW_WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for a in range(0, len(some), 20_000):
                which.append(some[a:a + 20_000])
                part = self._side_by_side([units[i] for i in which[-1]], width)
                ids.append(part[0])
                counts.append(part[1])
        for k in np.flatnonzero(sizes > low):
            which.append([k])
            ids.append(self._heap(units[k]))
            counts.append([len(ids[-1])])
        if not which:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        which, ids, counts = np.concatenate(which), np.concatenate(ids), np.concatenate(counts)
        starts = np.cumsum(counts) - counts
        order = np.argsort(which)
        counts = counts[order]
        ids = ids[flat.spread(starts[order], counts)]
        self._check(units, ids, counts)
        return ids, counts

    def _side_by_side(self, units: list[str], width: int) -> list:
        points = np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le"), np.uint32).reshape(-1, width)
        sizes = np.array([len(u) for u in units])
        symbols = np.where(np.arange(width) < sizes[:, None], self.of_point[points], -1)
        union = np.full(symbols.shape, -1, np.int32)
        score = np.full(symbols.shape, -np.inf)
        union[:, :-1], score[:, :-1] = self.pair(symbols[:, :-1], symbols[:, 1:])
        out = np.full(symbols.shape, -1, np.int32)
        rows, column = np.arange(len(units)), np.arange(width)
        while len(rows):
            best = score.argmax(axis=1)  # the leftmost of the best
            line = np.arange(len(rows))
            on = score[line, best] > -np.inf
            out[rows[~on]] = symbols[~on]
            rows, best, symbols, union, score = rows[on], best[on], symbols[on], union[on], score[on]
            line = np.arange(len(rows))
            symbols[line, best] = union[line, best]
            move = np.minimum(column + (column > best[:, None]), width - 1)  # closes the gap of the right symbol
            last = symbols[:, -1].copy()
            symbols, union, score = (np.take_along_axis(x, move, axis=1) for x in (symbols, union, score))
            symbols[:, -1] = np.where(best == width - 1, last, -1)
            union[:, -1], score[:, -1] = -1, -np.inf
            after = np.minimum(best + 1, width - 1)
            union[line, best], score[line, best] = self.pair(symbols[line, best], np.where(after > best, symbols[line, after], -1))
            before = np.maximum(best - 1, 0)
            left_union, left_score = self.pair(np.where(best > 0, symbols[line, before], -1), symbols[line, best])
            some = best > 0
            union[line[some], before[some]], score[line[some], before[some]] = left_union[some], left_score[some]
        return self._ids(out)

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are left (padded by -1) as ids, and their numbers; outsiders become bytes."""
        held = symbols >= 0
        ids, counts = symbols[held], held.sum(axis=1)
        outside = (symbols >= self.size).any(axis=1)
        if not outside.any():
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(outside):
            parts[k] = self._with_bytes(parts[k].tolist())
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def _with_bytes(self, symbols: list[int]) -> np.ndarray:
        ids: list[int] = []
        for s in symbols:
            ids += [s] if s < self.size else [self.bytes[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass")]
        return np.array(ids, np.int32)

    def _heap(self, unit: str) -> np.ndarray:
        symbols = self.of_point[np.frombuffer(unit.encode("utf-32-le"), np.uint32)].tolist()
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple] = []

        def offer(a: int, b: int):
            if a >= 0 and b >= 0:
                union = self.table.get(symbols[a] << SYMBOL | symbols[b])
                if union is not None:
                    heapq.heappush(agenda, (-self.scores[union], a, b, symbols[a], symbols[b], union))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, was_a, was_b, union = heapq.heappop(agenda)
            if symbols[a] != was_a or symbols[b] != was_b or right[a] != b:
                continue  # one of the two has been joined meanwhile
            symbols[a], symbols[b] = union, -1
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return self._with_bytes([s for s in symbols if s >= 0])

    def _check(self, units: list[str], ids: np.ndarray, counts: np.ndarray):
        """Behind a line end each unit is encoded by the library as here."""
        lead = self.library.encode("\n")
        at = np.concatenate([[0], np.cumsum(counts)])
        for a in range(0, len(units), 10_000):
            part = units[a:a + 10_000]
            theirs = self.library.encode(["\n" + u.replace(BLANK, " ") for u in part], num_threads=1)
            sizes = np.array([len(t) for t in theirs]) - len(lead)
            every = np.fromiter(itertools.chain.from_iterable(theirs), np.int32)
            own = ids[at[a]:at[a + len(part)]]
            starts = np.cumsum(sizes + len(lead)) - sizes
            if (sizes != counts[a:a + len(part)]).any() or (every[flat.spread(starts, sizes)] != own).any():
                raise RuntimeError("sentencepiece encodes a unit of this batch differently")

class Encoder:
    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.units = Units(self.vocabulary.encode, UNITS_KEPT)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts with the begin and end ids."""
        v = self.vocabulary
        cut = [UNIT.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        ids, counts = self.units.ids_of([u for c in cut for u in c])
        at = per_text(counts, [len(c) for c in cut])
        # one place more on either side of each text
        out = np.empty(len(ids) + 2 * len(texts), np.int32)
        k = np.arange(len(texts))
        begins, ends = at[:-1] + 2 * k, at[1:] + 2 * k + 1
        inner = np.ones(len(out), bool)
        inner[begins] = inner[ends] = False
        out[inner], out[begins], out[ends] = ids, v.begin, v.end
        return [out[a:b + 1] for a, b in zip(begins, ends)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.vocabulary.library.decode([i.tolist() for i in ids], num_threads=1)


def _model(spark: SparkSession, path: str | None):
    """The model file, read by the driver and sent to the executors (half a megabyte)."""
    with open(path or model_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoder(held) -> Encoder:
    key = hashlib.sha256(held.value).hexdigest()
    return flat.in_worker(f"pieces{key}", lambda: Encoder(held.value))


def _run(docs: DataFrame, path: str | None, rows_of, schema: str) -> DataFrame:
    held = _model(docs.sparkSession, path)

    def run(batches):
        encoder = _encoder(held)
        for batch in batches:
            for part in flat.slices(batch):
                texts = [t.as_py() or "" for t in part.column("text")]
                yield rows_of(encoder, part.column("doc_id"), encoder.encode(texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (with begin and end) and the text that they decode to."""
    def rows_of(encoder, doc_id, ids):
        at = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
        return pa.RecordBatch.from_arrays([doc_id, lists, pa.array(encoder.decode(ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return _run(docs, path, rows_of, ENCODED)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, SHA-256 of the ids and of the decoded text."""
    def rows_of(encoder, doc_id, ids):
        sha = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
        back = [hashlib.sha256(t.encode()).hexdigest() for t in encoder.decode(ids)]
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array([len(i) for i in ids], pa.int64()), pa.array(sha), pa.array(back)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs, path, rows_of, DIGESTS)

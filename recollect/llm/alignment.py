"""Cross-tokenizer alignment (11): a byte-level vocabulary A and a SentencePiece vocabulary B over the same bytes.

A encodes a space and the text, B the text (to which it adds the space); byte offsets where tokens of both end cut them into groups,
and tokens whose byte ranges overlap are linked. How many documents hold an id pair linked is counted over the whole corpus:

1. Every text is encoded once; ids go to a scratch table.
2. Each task aligns its documents and adds up the documents of its distinct pairs, packed by shard (a hash of the pair).
   The keys of a shard are united up a tree of tasks.
3. A minimal perfect hash is built for each shard: bit arrays of several levels; a key sits where it alone hashes to at the first level
   where it is alone, and its index is the rank of that bit. The keys stand beside it in index order, to verify what is looked up.
4. The tasks' counts become dense vectors, indexed by the hash, and are summed up a tree as well.
5. The documents are aligned again from their ids; counts are looked up in the perfect hashes. Shards are broadcast in blocks of
   `BLOCK_PAIRS` pairs, one pass over the ids for each block; partial sums of several blocks are added by document.

Bounds: a shard has at most 1/256 of the pairs that the two vocabularies allow; a task holds `HELD_PAIRS` distinct pairs before it
hands them on; the best count of each A id is one number for each entry of the vocabulary.

Cases: null and empty texts, and texts whose tokens of A or B don't join to the space and the text, have no tokens: zeros and an empty
groups string. Names of special tokens inside a text are plain text. Repeated rows count as documents of their own; null ids and further
columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import flat
from recollect.session import cut_lineage

BLOCK_PAIRS = 1 << 21  # of a broadcast: about 35 MB
HELD_PAIRS = 1 << 20
SHARDS = 256
FAN = 32  # blobs that one node of a tree adds up
GAMMA = 1.6  # bits for each key left at a level

# Fixed value: how byte-level vocabularies of this family cut a text before pairs are joined.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Runs without a cut make the splitting engine slow or fail; such texts go to the tokenizers library.
LONG_RUN = 10_000


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- tokens ------------------------------------------------------------------------------------------

def byte_of_sign() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: visible Latin-1 signs stand for themselves, the other bytes
    for the signs from 256 on, in order."""
    own = {b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Spelling:
    """Bytes of each token of a vocabulary, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[flat.spread(self.at[ids], self.sizes[ids])]


class Encoders:
    """Both vocabularies. A is run by tiktoken with the ranks of the tokenizers file; one text of each batch
    is checked against the tokenizers library."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(a_file.decode())
        self.library.encode_special_tokens = True
        described = json.loads(a_file)
        model = described["model"]
        signs = byte_of_sign()
        special = {t["content"] for t in described.get("added_tokens", [])}
        ranks = {bytes(signs[c] for c in t): k for t, k in model["vocab"].items() if t not in special}
        merged = [bytes(signs[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if described["pre_tokenizer"]["type"] != "ByteLevel" or described.get("normalizer") or [ranks[m] for m in merged] != sorted(
                ranks[m] for m in merged):
            raise ValueError("A has to be a byte-level vocabulary whose ids follow its merges")
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        of = {k: t for t, k in ranks.items()}
        self.a = Spelling([of.get(k, b"") for k in range(max(model["vocab"].values()) + 1)])

        self.pieces = p = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.b = Spelling([bytes([int(p.id_to_piece(k)[3:5], 16)]) if p.is_byte(k) else
                           b"" if p.is_control(k) or p.is_unknown(k) else p.id_to_piece(k).replace("▁", " ").encode()
                           for k in range(p.get_piece_size())])

    def _a(self, text: str) -> np.ndarray:
        if len(text) > LONG_RUN and longest_run(text) > LONG_RUN:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B for each text; none where the bytes of either are not the space and the text."""
        none = np.zeros(0, np.int64)
        a, b = [none] * len(texts), [none] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        for k, ids in zip(some, self.pieces.encode([texts[k] for k in some], num_threads=1)):
            own, theirs = self._a(f" {texts[k]}"), np.array(ids, np.int64)
            raw = np.frombuffer(f" {texts[k]}".encode(), np.uint8)
            if np.array_equal(self.a.spell(own), raw) and np.array_equal(self.b.spell(theirs), raw):
                a[k], b[k] = own, theirs
        if some:
            least = min(some, key=lambda k: len(texts[k]))
            if len(a[least]) and self.library.encode(f" {texts[least]}", add_special_tokens=False).ids != a[least].tolist():
                raise RuntimeError("tokenizers encodes a text of this batch differently")
        return a, b


def longest_run(text: str) -> int:
    """Signs in the longest stretch of only white space or of no white space."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    change = np.flatnonzero(np.diff(np.isin(raw, [9, 10, 11, 12, 13, 32]).astype(np.int8)))
    return int(np.diff(np.concatenate([[-1], change, [len(raw) - 1]])).max())


# --- alignment ---------------------------------------------------------------------------------------

class Aligned:
    """Links of the documents of one slice. `links` holds the keys (A id, B id) in byte order, `ends` how many links the
    documents up to and with each have; `n_groups` and `n_a`, `n_b` likewise for each document."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray):
        ids_a, ids_b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        self.n_a, self.n_b = (np.array([len(i) for i in x], np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(a_sizes[ids_a]), np.cumsum(b_sizes[ids_b])
        mark = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, np.uint8)
        mark[end_a] |= 1
        mark[end_b] |= 2
        cuts = np.flatnonzero(mark)
        of_a, of_b = (mark[cuts] & 1).astype(np.int64), (mark[cuts] >> 1).astype(np.int64)
        self.upto_a, self.upto_b = np.cumsum(of_a), np.cumsum(of_b)
        common = (of_a & of_b).astype(bool)
        self.a_ids = ids_a[self.upto_a - of_a]
        self.links = self.a_ids << 32 | ids_b[self.upto_b - of_b]
        stops = np.cumsum(self.n_a)
        self.ends = np.where(stops > 0, np.searchsorted(self.upto_a, stops, "left") + 1, 0) if len(cuts) else np.zeros(len(a), np.int64)
        self.upto_group = np.cumsum(common)
        self.n_groups = np.diff(np.concatenate([[0], self.upto_group])[np.concatenate([[0], self.ends])])
        self.common, self.is_a, self.is_b, self.ids = common, of_a.astype(bool), of_b.astype(bool), (ids_a, ids_b)

    def doc(self) -> np.ndarray:
        """The document of each link."""
        return np.repeat(np.arange(len(self.ends)), np.diff(np.concatenate([[0], self.ends])))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the links' values for each document."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(total[np.concatenate([[0], self.ends])])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the slice and the number of documents that hold each."""
        which, keys = pd.factorize(self.links)
        once = pd.unique(self.doc() * max(len(keys), 1) + which)
        return keys, np.bincount(once % max(len(keys), 1), minlength=len(keys))

    def groups(self, table: Decimals) -> list[bytes]:
        """The groups of each document: A ids, a bar, B ids; groups are kept apart by semicolons."""
        ids_a, ids_b = self.ids
        ends = np.flatnonzero(self.common)
        a_upto, b_upto = self.upto_a[ends], np.concatenate([[0], self.upto_b[ends]])
        group = self.upto_group - self.common
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        at_a, at_b = np.flatnonzero(self.is_a), np.flatnonzero(self.is_b)
        codes[np.arange(len(ids_a)) + b_upto[group[at_a]]] = 2 * ids_a + self.common[at_a]
        codes[np.arange(len(ids_b)) + a_upto[group[at_b]]] = 2 * (table.n_a + ids_b) + self.common[at_b]
        sizes = table.sizes[codes]
        data = table.signs[codes][np.arange(table.signs.shape[1]) < sizes[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [data[i:max(i, j - 1)] for i, j in zip(at[:-1], at[1:])]


class Decimals:
    """Decimal signs of all ids with the sign behind them: a comma inside a run, else a bar (A) or a semicolon (B)."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a = n_a
        made = [f"{k}{end}".encode() for n, last in ((n_a, "|"), (n_b, ";")) for k in range(n) for end in (",", last)]
        self.sizes = np.array([len(m) for m in made])
        width = int(self.sizes.max())
        self.signs = np.frombuffer(b"".join(m.ljust(width) for m in made), np.uint8).reshape(-1, width)


# --- minimal perfect hashes --------------------------------------------------------------------------

def shard_of(keys: np.ndarray) -> np.ndarray:
    return (flat.mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(56)).astype(np.int64)


def _place(keys: np.ndarray, level: int, size) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (flat.mix(flat.mix(keys.astype(np.uint64) ^ seed) + seed) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits one after the other, and the distinct `keys` in the order of their index."""
    sizes, bits, left = [], [], keys
    while len(left):
        if len(sizes) == 99:
            raise RuntimeError("keys are not distinct")
        size = max(8, int(GAMMA * len(left)))
        at = _place(left, len(sizes), size)
        n = np.bincount(at, minlength=size)
        sizes.append(size)
        bits.append(n == 1)
        left = left[n[at] > 1]
    bits = np.concatenate(bits) if bits else np.zeros(0, bool)
    placed = np.empty_like(keys)
    placed[Index([sizes], bits, None, [0]).find(keys)] = keys
    return sizes, bits, placed


class Index:
    """Perfect hashes of several shards, one behind the other. `find` gives the index of each key, or -1: with `keys`, the keys
    in index order, whatever isn't one of them is found out."""

    def __init__(self, sizes: list[list[int]], bits: np.ndarray, keys: np.ndarray | None, shards: list[int]):
        self.bits, self.keys = bits, keys
        self.rank = np.cumsum(bits, dtype=np.int64) - 1
        self.levels = max(map(len, sizes), default=0)
        self.sizes = np.zeros((SHARDS, self.levels), np.int64)
        self.single = len(shards) == 1 and keys is None
        for k, own in zip(shards, sizes):
            self.sizes[k, :len(own)] = own
        self.at = (np.cumsum(self.sizes.ravel()) - self.sizes.ravel()).reshape(self.sizes.shape)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        shard = np.zeros(len(keys), np.int64) if self.single else shard_of(keys)
        left = np.arange(len(keys))
        for level in range(self.levels):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            at = self.at[shard[left], level] + _place(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        if self.keys is not None and len(self.keys):
            out[self.keys[np.maximum(out, 0)] != keys] = -1
        return out


# --- the passes --------------------------------------------------------------------------------------

class Tools:
    """The two files on the executors, and what is derived from them."""

    def __init__(self, spark: SparkSession, a_path: str | None, b_path: str | None):
        default = paths() if a_path is None or b_path is None else (None, None)
        with open(a_path or default[0], "rb") as f, open(b_path or default[1], "rb") as g:
            files = f.read(), g.read()
        self.files = spark.sparkContext.broadcast(files)
        self.name = f"alignment{zlib.crc32(files[0])}-{zlib.crc32(files[1])}"
        own = Encoders(*files)
        self.sizes = spark.sparkContext.broadcast((own.a.sizes, own.b.sizes))
        self.kind = "<u2" if max(len(own.a.sizes), len(own.b.sizes)) <= 1 << 16 else "<u4"  # of ids between the passes

    def encoders(self) -> Encoders:
        return flat.in_worker(self.name, lambda: Encoders(*self.files.value))

    def decimals(self) -> Decimals:
        return flat.in_worker(f"{self.name}signs", lambda: Decimals(*map(len, self.sizes.value)))

    def aligned(self, batch: pa.RecordBatch):
        """The batch in slices, each with its links."""
        for part in flat.slices(batch, "a", 1 << 19):
            a, b = ([np.frombuffer(x.as_py(), self.kind).astype(np.int64) for x in part.column(c)] for c in ("a", "b"))
            yield part, Aligned(a, b, *self.sizes.value)


def encoded(docs: DataFrame, tools: Tools) -> DataFrame:
    """row, doc_id and the ids of A and B of each document, written."""
    def run(batches):
        encoders = tools.encoders()
        for batch in batches:
            for part in flat.slices(batch):
                a, b = encoders.encode([t or "" for t in part.column("text").to_pylist()])
                made = [pa.array([x.astype(tools.kind).tobytes() for x in ids], pa.binary()) for ids in (a, b)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", "a", "b"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, a binary, b binary")
    return cut_lineage(ids.withColumn("row", F.monotonically_increasing_id()))


PACKED = "shard long, node long, keys binary, counts binary"


def packed_counts(ids: DataFrame, tools: Tools) -> DataFrame:
    """Each task's distinct pairs by shard, sorted, and how many of its documents hold each."""
    def emit(held):
        keys, n = _united([k for k, _ in held], [c for _, c in held])
        shard = shard_of(keys)
        order = np.argsort(shard, kind="stable")
        keys, n, at = keys[order], n[order], np.searchsorted(shard[order], np.arange(SHARDS + 1))
        full = np.flatnonzero(np.diff(at))
        node = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(np.full(len(full), node)), *(pa.array([x[at[s]:at[s + 1]].astype("<i8").tobytes() for s in full], pa.binary())
                                                                  for x in (keys, n))], names=["shard", "node", "keys", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, links in tools.aligned(batch):
                held.append(links.pairs())
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    held = [_united([k for k, _ in held], [c for _, c in held])]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield emit(held)
                        held, size = [], 0
        if size:
            yield emit(held)

    return cut_lineage(ids.select("a", "b").mapInArrow(run, PACKED))


def _united(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    which, distinct = pd.factorize(keys, sort=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, which, counts)
    return distinct, out


def _by_node(rows: DataFrame, run, schema: str, *order: str) -> DataFrame:
    """`run` over the rows of each shard and node, which come one after the other."""
    return rows.repartition("shard", "node").sortWithinPartitions("shard", "node", *order).mapInArrow(run, schema)


def _runs(batches, columns: tuple[str, ...]):
    """((shard, node), row) of every row, row being a tuple of the columns."""
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "node", *columns))):
            yield row[:2], row[2:]


def _folded(rows: DataFrame, column: str, add) -> DataFrame:
    """A column of blobs (64-bit numbers) added up a tree, to one row for each shard."""
    nodes = rows.agg(F.max("node")).first()[0] or 0

    def run(batches):
        key, held = None, None
        for at, (blob,) in _runs(batches, (column,)):
            blob = np.frombuffer(blob, "<i8")
            if at != key:
                if key:
                    yield _blob(key, column, held)
                key, held = at, blob
            else:
                held = add(held, blob)
        if key:
            yield _blob(key, column, held)

    out = rows.select("shard", "node", column)
    while nodes:
        out, nodes = out.withColumn("node", F.floor(F.col("node") / FAN)), nodes // FAN
        out = _by_node(out, run, f"shard long, node long, {column} binary")
    return cut_lineage(_by_node(out, run, f"shard long, node long, {column} binary"))


def _blob(key, column: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([values.astype("<i8").tobytes()], pa.binary())],
                                      names=["shard", "node", column])


HASHES = "shard long, sizes array<long>, bits binary, keys binary, n long"


def perfect_hashes(packed: DataFrame) -> DataFrame:
    """A minimal perfect hash for each shard of the pairs: sizes of levels, bits, keys in index order and their number."""
    def run(batches):
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("keys")):
                sizes, bits, keys = perfect_hash(np.frombuffer(blob.as_py(), "<i8"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([sizes], pa.list_(pa.int64())), pa.array([np.packbits(bits).tobytes()], pa.binary()),
                     pa.array([keys.tobytes()], pa.binary()), pa.array([len(keys)])], names=["shard", "sizes", "bits", "keys", "n"])

    union = _folded(packed, "keys", np.union1d)
    return cut_lineage(union.select("shard", "keys").mapInArrow(run, HASHES))


def _index(shards: list[int], sizes: list[list[int]], bits: list[bytes], keys: list[bytes]) -> Index:
    return Index(sizes, np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=sum(s)).astype(bool) for s, b in zip(sizes, bits)])
                 if shards else np.zeros(0, bool), np.frombuffer(b"".join(keys), "<i8"), shards)


def dense_counts(packed: DataFrame, hashes: DataFrame) -> DataFrame:
    """shard and its count vector: a number for each index of its hash."""
    nodes = packed.select("shard", F.floor(F.col("node") / FAN).alias("node"), F.lit(1).alias("kind"), "keys", "counts")
    heads = nodes.select("shard", "node").distinct().join(hashes.drop("n"), "shard").withColumn("kind", F.lit(0))

    def run(batches):
        key, index, held = None, None, None
        for at, (kind, sizes, bits, keys, counts) in _runs(batches, ("kind", "sizes", "bits", "keys", "counts")):
            if kind == 0:
                if key:
                    yield _blob(key, "vector", held)
                key, index = at, _index([at[0]], [sizes], [bits], [keys])
                held = np.zeros(len(index.keys), np.int64)
                continue
            slots = index.find(np.frombuffer(keys, "<i8"))
            if (slots < 0).any():
                raise RuntimeError("a pair is not in the hash of its shard")
            held[slots] += np.frombuffer(counts, "<i8")
        if key:
            yield _blob(key, "vector", held)

    both = heads.unionByName(nodes, allowMissingColumns=True)
    vectors = cut_lineage(_by_node(both, run, "shard long, node long, vector binary", "kind"))
    return _folded(vectors, "vector", np.add)


def _best(hashes: DataFrame, vectors: DataFrame, n_a: int) -> np.ndarray:
    """The highest count of each A id: one number for each entry of the vocabulary."""
    def run(batches):
        for batch in batches:
            for keys, vector in zip(batch.column("keys"), batch.column("vector")):
                a, n = np.frombuffer(keys.as_py(), "<i8") >> 32, np.frombuffer(vector.as_py(), "<i8")
                order = np.lexsort((n, a))
                last = np.append(np.diff(a[order]) > 0, True)
                yield pa.RecordBatch.from_arrays([pa.array(a[order][last]), pa.array(n[order][last])], names=["a", "n"])

    found = hashes.join(vectors, "shard").select("keys", "vector").mapInArrow(run, "a long, n long").groupBy("a").agg(F.max("n").alias("n"))
    out = np.zeros(n_a, np.int64)
    got = found.toPandas()
    out[got["a"].to_numpy()] = got["n"].to_numpy()
    return out


ROWS = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
        "groups string")


def _looked_up(ids: DataFrame, tools: Tools, block: list, best, with_groups: bool) -> DataFrame:
    """The rows of all documents, counts taken from one block of shards."""
    held = ids.sparkSession.sparkContext.broadcast(block)

    def make():
        rows = held.value
        return _index(*([r[k] for r in rows] for k in range(4))), np.frombuffer(b"".join(r[4] for r in rows), "<i8")

    def run(batches):
        index, vector = make()
        for batch in batches:
            for part, links in tools.aligned(batch):
                which, keys = pd.factorize(links.links)
                slots = index.find(keys)
                counts = np.where(slots >= 0, vector[slots] if len(vector) else 0, 0)[which]
                n_best = links.sums((counts > 0) & (counts == best.value[links.a_ids]))
                groups = links.groups(tools.decimals())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *map(pa.array, (links.n_a, links.n_b, links.n_groups, links.sums(np.ones(len(which))),
                                                                                n_best, links.sums(counts))),
                     pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
                     pa.array([g.decode() if with_groups else None for g in groups], pa.string())], names=[c.split()[0] for c in ROWS.split(", ")])

    return ids.mapInArrow(run, ROWS)


def corpus(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[Tools, DataFrame, DataFrame, DataFrame]:
    """Encoded documents, the perfect hashes of all linked id pairs and their count vectors."""
    tools = Tools(docs.sparkSession, a_path, b_path)
    ids = encoded(docs, tools)
    packed = packed_counts(ids, tools)
    hashes = perfect_hashes(packed)
    return tools, ids, hashes, dense_counts(packed, hashes)


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b, n: how many documents hold the id pair linked."""
    def run(batches):
        for batch in batches:
            for keys, vector in zip(batch.column("keys"), batch.column("vector")):
                keys = np.frombuffer(keys.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & (1 << 32) - 1), pa.array(np.frombuffer(vector.as_py(), "<i8"))],
                                                 names=["a", "b", "n"])

    _, _, hashes, vectors = corpus(docs, a_path, b_path)
    return hashes.join(vectors, "shard").select("keys", "vector").mapInArrow(run, "a long, b long, n long")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if wanted, groups."""
    tools, ids, hashes, vectors = corpus(docs, a_path, b_path)
    sc = ids.sparkSession.sparkContext
    best = sc.broadcast(_best(hashes, vectors, len(tools.sizes.value[0])))
    blocks, held = [[]], 0
    for shard, n in hashes.select("shard", "n").orderBy("shard").collect():  # at most SHARDS rows
        if held and held + n > block_pairs:
            blocks.append([])
            held = 0
        blocks[-1].append(shard)
        held += n
    table = hashes.join(vectors, "shard").select("shard", "sizes", "bits", "keys", "vector")
    parts = []
    for own in blocks:
        rows = [tuple(r) for r in table.where(F.col("shard").isin(own)).orderBy("shard").collect()] if own else []
        parts.append(_looked_up(ids, tools, rows, best, with_groups))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    if len(parts) == 1:
        return parts[0].select(*columns)
    every = cut_lineage(parts[0])
    for part in parts[1:]:
        every = every.unionByName(cut_lineage(part.select("row", "n_best", "count_sum")), allowMissingColumns=True)
    kept = [F.max(c).alias(c) for c in columns if c not in ("n_best", "count_sum")]
    return every.groupBy("row").agg(*kept, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).select(*columns)

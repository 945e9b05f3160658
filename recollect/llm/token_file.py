"""Token ids and their binary form (1): frequency-ranked ids in a byte-aligned code with separate control bytes.

Writing: every text is encoded once and an end id appended; the ids are counted over all documents and ranked by
falling count (then by id), so that frequent ids have small numbers. Documents are range-partitioned by doc_id
and packed, in that order, into blocks of about `BLOCK_IDS` ids. A rank takes one to four bytes, little end first; two bits of a control byte
hold the number of bytes less one, four ranks to a control byte (the last one padded with one-byte zeros that are not stored as data).

The file is a folder: `ranks` (rank, id: one row for each id of the vocabulary) and `blocks`, Parquet with a row for each block:
block (long, unique), first_id, first_tag, first_row (sort key of its first document), doc_ids, sizes (ids of
each document), n_ids, control, data (binary). Spark writes it, so a task that runs again leaves no half-written
block, and any store that Spark reaches will do. Reading decodes a block by a table of the 256 control
bytes: length of each group of four and place and width of its members.

Cases: a null or empty text has the end id only. Null doc_id comes first, rows with one id are ordered by a hash of the text;
equal rows are each written. A text longer than a block has a block of its own. An empty table gives no block.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import flat, rows
from recollect.llm.units import Units, per_text
from recollect.operators.skew import running
from recollect.session import checkpoint_dir, cut_lineage

BLOCK_IDS = 1 << 20
END_ID = 2
MARK = "<|endoftext|>"
WORDS_KEPT = 1_500_000  # by a Python worker: about 250 MB

# A full stop or comma after a letter and before a blank is a token of its own; taken off, it leaves more words alike.
STOP = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])([.,])(?= )")
RUN_ON = re.compile(r"[^ \t\n\r0-9A-Za-zÀ-ÖØ-öø-ÿ][.,] ")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- the code ----------------------------------------------------------------------------------------

def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    widths = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < widths[:, None]]
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = widths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each control byte: widths of its four members, their places, and the length of the group."""
    widths = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
    ends = widths.cumsum(axis=1)
    return widths, ends - widths, ends[:, 3]


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that `pack` took."""
    widths, places, group = _tables()
    control = np.frombuffer(control, np.uint8)
    data = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    ends = np.cumsum(group[control])
    at = ((ends - group[control])[:, None] + places[control]).ravel()[:n]
    width = widths[control].ravel()[:n]
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        some = np.flatnonzero(width > k)
        out[some] |= data[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- encoding ----------------------------------------------------------------------------------------

class Encoder:
    """Whole texts by the tokenizers library; words that were met before are looked up. Tokens of such a
    vocabulary (white space dropped between words) never reach over a blank or line end."""

    def __init__(self, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer, normalizers

        self.library = Tokenizer.from_str(model.decode())
        # Words met for the first time fill no cache here. For words in small Latin-1 letters the vocabulary's
        # normaliser (composition, white space, lower case) changes nothing, so they are spared it.
        self.new_words, self.small_words = (Tokenizer.from_str(model.decode()) for _ in range(2))
        self.small_words.normalizer = normalizers.Sequence([])
        for tokenizer in (self.new_words, self.small_words):
            tokenizer.model._resize_cache(0)
        self.units = Units(self._encode, WORDS_KEPT)
        self.mark = self.library.token_to_id(MARK)
        probe = "Ab, cd.\nef  gh's 12"
        if self.library.encode(probe, add_special_tokens=False).ids != [
                i for w in probe.split() for i in self.library.encode(w, add_special_tokens=False).ids]:
            raise ValueError("tokens of this vocabulary reach over white space")

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many units in one call, a special token between them; units that hold one go by themselves."""
        ids, counts = [], []
        for a in range(0, len(units), 1_000):
            part = units[a:a + 1_000]
            text = MARK.join(part)
            if self.mark is None or text.count("<|") != len(part) - 1:
                got = [e.ids for e in self.library.encode_batch(part, add_special_tokens=False)]
                counts.append([len(g) for g in got])
                ids.append(np.array([i for g in got for i in g], np.int32))
                continue
            small = text.isascii() or max(text) < "\u0100"
            by = self.small_words if small and text == text.lower() else self.new_words
            got = np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(got == self.mark)
            if len(at) != len(part) - 1:
                raise RuntimeError("the mark between units was not kept")
            counts.append(np.diff(np.concatenate([[-1], at, [len(got)]])) - 1)
            ids.append(got[got != self.mark])
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END_ID behind each, and where each begins."""
        cut = [self._units(t) for t in texts]
        ids, counts = self.units.ids_of([u for c in cut for u in c])
        at = per_text(counts, [len(c) for c in cut])
        k = np.arange(len(at))
        out = np.full(len(ids) + len(texts), END_ID, np.int32)
        inner = np.ones(len(out), bool)
        inner[at[1:] + k[:-1]] = False
        out[inner] = ids
        return out, at + k

    @staticmethod
    def _units(text: str) -> list[str]:
        if SPECIAL.search(text):
            return [text]  # names of special tokens may stand across what is cut here
        text = text.replace("\n", " ")
        try:
            text.encode("latin-1")
            text = text.lower()  # sign by sign, as the vocabulary does
        except UnicodeEncodeError:
            pass
        text += " "
        if RUN_ON.search(text):
            text = STOP.sub(r" \1", text)
        else:
            text = text.replace(". ", " . ").replace(", ", " , ")
        return list(filter(None, text.split(" ")))


def _encoder(held) -> Encoder:
    return flat.in_worker(f"words{zlib.crc32(held.value)}", lambda: Encoder(held.value))


def _kind(size: int) -> str:
    """How ids are kept between the steps: two bytes each where the vocabulary allows."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _encoded(docs: DataFrame, held, kind: str) -> DataFrame:
    """id, tag and the ids (binary, of `kind`) of each document."""
    width = np.dtype(kind).itemsize

    def run(batches):
        encoder = _encoder(held)
        for batch in batches:
            for part in flat.slices(batch):
                ids, at = encoder.encode([t.as_py() for t in part.column("text")])
                raw = ids.astype(kind).tobytes()
                made = pa.array([raw[width * a:width * b] for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), made], names=["id", "tag", "ids"])

    return rows.keyed(docs).mapInArrow(run, "id long, tag long, ids binary")


def _counted(encoded: DataFrame, kind: str) -> DataFrame:
    """Occurrences of each id: a row for each id and task goes to the shuffle."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in flat.slices(batch, "ids"):
                got = np.bincount(flat.flatten(part.column("ids"))[0].view(kind))
                if len(got) > len(total):
                    total, got = got, total
                total[:len(got)] += got
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], names=["token", "n"])

    return encoded.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def ranked(counts: DataFrame, size: int) -> np.ndarray:
    """All ids of a vocabulary of `size`, the most frequent first; the counts are at most `size` rows."""
    n = np.zeros(size, np.int64)
    got = counts.toPandas()
    n[got["token"].to_numpy()] = got["n"].to_numpy()
    return np.lexsort((np.arange(size), -n)).astype(np.int64)


BLOCKS = ("block long, first_id long, first_tag long, first_row long, doc_ids array<long>, sizes array<long>, n_ids long, "
          "control binary, data binary")


def _packed(encoded: DataFrame, rank_of, kind: str) -> DataFrame:
    """Blocks of the rows of each partition, which come sorted."""
    def emit(task, k, keys, ids, sizes):
        control, data = pack(rank_of.value[np.concatenate(ids)])
        return pa.RecordBatch.from_pylist([{
            "block": task << 32 | k, "first_id": keys[0][0], "first_tag": keys[0][1], "first_row": keys[0][2],
            "doc_ids": [key[0] for key in keys], "sizes": sizes, "n_ids": sum(sizes), "control": control, "data": data}],
            pa.schema([("block", pa.int64()), ("first_id", pa.int64()), ("first_tag", pa.int64()), ("first_row", pa.int64()),
                       ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_ids", pa.int64()),
                       ("control", pa.binary()), ("data", pa.binary())]))

    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        keys, ids, sizes, held = [], [], [], 0
        for batch in batches:
            for key, own in zip(zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "row"))), batch.column("ids")):
                own = np.frombuffer(own.as_py(), kind)
                if held and held + len(own) > BLOCK_IDS:
                    yield emit(task, k, keys, ids, sizes)
                    keys, ids, sizes, held, k = [], [], [], 0, k + 1
                keys.append(key)
                ids.append(own)
                sizes.append(len(own))
                held += len(own)
        if keys:
            yield emit(task, k, keys, ids, sizes)

    return encoded.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> str:
    """Write the token file of the documents to the folder `path` and return it."""
    spark = docs.sparkSession
    with open(tokenizer or tokenizer_path(), "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    size = max(Encoder(held.value).library.get_vocab_size(), END_ID + 1)
    kind = _kind(size)
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/recollect-{uuid.uuid4().hex}"
    _encoded(docs, held, kind).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(scratch)
    encoded = spark.read.parquet(scratch)
    order = ranked(_counted(encoded, kind), size)
    spark.createDataFrame(pa.table({"rank": np.arange(size), "id": order})).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(size, np.uint32)
    rank_of[order] = np.arange(size)
    keys = ("id", "tag", "row")
    ordered = encoded.repartitionByRange(*keys).sortWithinPartitions(*keys)
    _packed(ordered, spark.sparkContext.broadcast(rank_of), kind).write.parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if wanted, ids (binary, unsigned 32-bit little-endian)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    id_of = spark.sparkContext.broadcast(np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4"))
    order = [F.col(c) for c in ("first_id", "first_tag", "first_row")]
    starts = running(blocks.select("block", "n_ids", "first_id", "first_tag", "first_row"), [], order, F.col("n_ids")).select(
        "block", (F.col("running") - F.col("n_ids")).alias("before"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block, doc_ids, sizes, n, control, data = (
                    batch.column(c)[k].as_py() for c in ("block", "doc_ids", "sizes", "n_ids", "control", "data"))
                raw = id_of.value[unpack(control, data, n)].tobytes()
                at = np.concatenate([[0], np.cumsum(sizes)])
                own = [raw[4 * a:4 * b] for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(own), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(o) for o in own], pa.int64()), pa.array(own if with_ids else [None] * len(own), pa.binary())],
                    names=["block", "id", "inside", "n_tokens", "ids_crc32", "ids"])

    decoded = blocks.select("block", "doc_ids", "sizes", "n_ids", "control", "data").mapInArrow(
        run, "block long, id long, inside long, n_tokens long, ids_crc32 long, ids binary")
    return decoded.join(cut_lineage(starts), "block").select(
        rows.real_id(F.col("id")).alias("doc_id"), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

"""Language ID (5): hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point. Three letters in a row are bound
into one vector: the first permuted twice (rotated by two places), the second once, the third as it is, and
multiplied place by place. Words are padded by a letter of their own on either side. A text is the sum of
its trigram vectors; a language is the sum over its training texts, scaled to unit length, less the mean of all languages,
so that what they share doesn't count. A text gets the language with the largest cosine.

Learning: each task adds up one vector for each language, whatever the number of texts, and the sums are added by
Spark; the prototypes are as many rows as there are languages, at most `MAX_LANGS`. Only text and lang of rows given to `learned` are read.

Cases: a null text, or one without a letter, is `und` with score 0. Rows without a language don't teach. Without any
training row every text is `und`. Ties go to the language first in the alphabet. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import flat

WIDTH = 2048
MAX_LANGS = 10_000
NONE = "und"
EDGE = 0
TABLE_ROWS = 30_000  # trigram vectors kept by a worker: 60 MB


def letter_vector(point: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=point + 1)).integers(0, 2, WIDTH, dtype=np.int8) * 2 - 1


class Letters:
    """Code points to letters in lower case, and trigrams to rows of a table of vectors."""

    def __init__(self):
        self.of_point = np.full(0x110000, -2, np.int32)  # not looked at yet
        self.vectors: dict[int, np.ndarray] = {}
        self.start()

    def start(self):
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, WIDTH), np.int8)

    def letters(self, points: np.ndarray) -> np.ndarray:
        """The letter of each code point, -1 for other signs. Marks belong to the letter before them and count as letters."""
        got = self.of_point[points]
        for p in np.unique(points[got == -2]).tolist():
            c = chr(p)
            low = c.lower()
            self.of_point[p] = (ord(low) if len(low) == 1 else p) if unicodedata.category(c)[0] == "L" else -1
        return self.of_point[points]

    def vector(self, letter: int) -> np.ndarray:
        if letter not in self.vectors:
            if len(self.vectors) > TABLE_ROWS:
                self.vectors.clear()
            self.vectors[letter] = letter_vector(letter)
        return self.vectors[letter]

    def row(self, key: int) -> int:
        if key not in self.rows:
            k = len(self.rows)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
            self.table[k] = np.roll(self.vector(a), 2) * np.roll(self.vector(b), 1) * self.vector(c)
            self.rows[key] = k
        return self.rows[key]

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of a text, each as one number, and how often they occur."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letters(points).astype(np.int64)
        held = letters >= 0
        if not held.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # an edge before and after each word; runs of other signs are one edge
        letters = np.concatenate([[EDGE], np.where(held, letters, EDGE), [EDGE]])
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] != EDGE) | (letters[:-1] != EDGE)
        letters = letters[keep]
        keys = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
        keys = keys[letters[1:-1] != EDGE]
        return np.unique(keys, return_counts=True)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors of trigrams."""
        if len(self.rows) + len(keys) > TABLE_ROWS:
            self.start()
        total = np.zeros(WIDTH)
        for a in range(0, len(keys), 4096):
            rows = np.array([self.row(k) for k in keys[a:a + 4096].tolist()])
            total += counts[a:a + 4096].astype(np.float32) @ self.table[rows].astype(np.float32)
            if len(self.rows) > TABLE_ROWS:
                self.start()
        return total


def _letters() -> Letters:
    return flat.in_worker("language_letters", Letters)


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes (unit rows), from text and lang of all rows of `docs`."""
    def run(batches):
        letters, sums = _letters(), {}
        for batch in batches:
            for part in flat.slices(batch):
                counts: dict = {}
                for text, lang in zip(part.column("text"), part.column("lang").to_pylist()):
                    own = counts.setdefault(lang, [])
                    own.append(letters.trigrams(text.as_py()))
                for lang, got in counts.items():
                    keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
                    total = letters.bundle(keys, np.bincount(at, np.concatenate([c for _, c in got]), len(keys)))
                    sums[lang] = sums.get(lang, 0) + total
        langs = list(sums)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array(langs, object), WIDTH), pa.string()), pa.array(np.tile(np.arange(WIDTH), len(langs)), pa.int32()),
            pa.array(np.concatenate([sums[k] for k in langs]) if langs else np.zeros(0))], names=["lang", "place", "value"])

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(run, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    packed = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v")).select("lang", "v.value")
    got = sorted((r.lang, r.value) for r in packed.limit(MAX_LANGS + 1).collect())
    if len(got) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    sums = np.array([v for _, v in got]).reshape(len(got), WIDTH)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return [k for k, _ in got], unit


def classify(letters: Letters, text: str | None, langs: list[str], unit: np.ndarray) -> tuple[str, float]:
    keys, counts = letters.trigrams(text or "")
    if not len(keys) or not langs:
        return NONE, 0.0
    vector = letters.bundle(keys, counts)
    centre = unit.mean(axis=0) if len(langs) > 1 else 0
    profile = unit - centre
    own = vector / np.linalg.norm(vector) - centre if vector.any() else vector
    norms = np.linalg.norm(profile, axis=1) * np.linalg.norm(own)
    cosine = profile @ own / np.maximum(norms, 1e-12)
    best = int(np.argmax(np.round(cosine, 12)))
    return langs[best], float(min(1.0, max(0.0, (1 + cosine[best]) / 2)))


def predicted(docs: DataFrame, langs: list[str], unit: np.ndarray, *carried) -> DataFrame:
    """One row per document: doc_id, the columns named, lang_pred and score; only the text is looked at."""
    held = docs.sparkSession.sparkContext.broadcast((langs, unit))

    def run(batches):
        letters = _letters()
        for batch in batches:
            for part in flat.slices(batch):
                got = [classify(letters, t.as_py(), *held.value) for t in part.column("text")]
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array([g[0] for g in got], pa.string()),
                                                  pa.array([g[1] for g in got], pa.float64())], names=[*kept, "lang_pred", "score"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields if f.name != "text")
    return told.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out():
    """Whether crc32 of the id as text leaves 1 when divided by 3; a row without id counts as text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def evaluated(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all."""
    langs, unit = learned(docs.where(~held_out()))
    return predicted(docs, langs, unit, held_out().alias("held_out"))

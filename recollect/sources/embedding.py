"""Embedding providers and the column that calls them."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.slices import by_slices
from recollect.sources.http import post_json


class Embedder(ABC):
    """Texts to vectors. Instances are shipped to the tasks, so they hold plain settings only."""

    name: str = "none"
    dimensions: int = 0
    remote: bool = False

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_one(self, text: str) -> list[float]:
        return [float(x) for x in self.embed([text])[0]]

    def info(self) -> dict:
        return {"model": self.name, "dimension": self.dimensions}


class HashingEmbedder(Embedder):
    """The offline default: signed word hashes, scaled to unit length. It carries word overlap,
    not meaning."""

    name = "hashing"

    def __init__(self, dimensions: int = 768):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        seen: dict[str, tuple[int, int]] = {}
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                if word not in seen:
                    h = zlib.crc32(word.strip(".,;:!?()[]\"'").encode())
                    seen[word] = (h >> 1) % self.dimensions, 1 if h & 1 else -1
                at, sign = seen[word]
                row[at] += sign
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0).astype("float32").tolist()


class OpenAICompatibleEmbedder(Embedder):
    """A14."""

    remote = True

    def __init__(self, url: str, model: str, dimensions: int = 768, key: str = "", batch: int = 64):
        self.url, self.name, self.dimensions, self.key, self.batch = url.rstrip("/"), model, dimensions, key, batch

    def embed(self, texts: list[str], send=None) -> list[list[float]]:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = texts[i:i + self.batch]
            reply = post_json(f"{self.url}/embeddings", {
                "model": self.name, "input": part, "dimensions": self.dimensions}, headers, send=send)
            rows = sorted(reply["data"], key=lambda r: r["index"])
            if len(rows) != len(part):
                raise ValueError(f"expected {len(part)} vectors, got {len(rows)}")
            out.extend(r["embedding"] for r in rows)
        return out


class GoogleEmbedder(Embedder):
    """A15."""

    remote = True

    def __init__(self, key: str, model: str = "text-embedding-004", dimensions: int = 768,
                 url: str = "https://generativelanguage.googleapis.com/v1beta", batch: int = 100):
        self.key, self.name, self.dimensions, self.url, self.batch = key, model, dimensions, url, batch

    def embed(self, texts: list[str], send=None) -> list[list[float]]:
        out: list[list[float]] = []
        model = f"models/{self.name}"
        for i in range(0, len(texts), self.batch):
            requests = [{"model": model, "content": {"parts": [{"text": t}]},
                         "outputDimensionality": self.dimensions} for t in texts[i:i + self.batch]]
            reply = post_json(f"{self.url}/{model}:batchEmbedContents", {"requests": requests},
                              {"x-goog-api-key": self.key}, send=send)
            out.extend(e["values"] for e in reply["embeddings"])
        return out


def vectors_for(texts, embedder: Embedder, tolerant: bool = False):
    """The vectors of a text column, in Arrow batches. If `tolerant`, a text that the provider
    refuses gets no vector, and the others of its batch theirs."""
    def one_by_one(texts: list[str]) -> list:
        if len(texts) == 1 or not tolerant:
            try:
                return embedder.embed(texts)
            except Exception:
                if not tolerant:
                    raise
                return [None]
        try:
            return embedder.embed(texts)
        except Exception:
            middle = len(texts) // 2
            return [*one_by_one(texts[:middle]), *one_by_one(texts[middle:])]

    def embed(part: pa.Array) -> pa.Array:
        filled = [t or "" for t in part.to_pylist()]
        return pa.array(one_by_one(filled) if filled else [], pa.list_(pa.float32()))

    return by_slices(embed, "array<float>", texts)


def embed_rows(rows: DataFrame, embedder: Embedder, text: str = "document",
               inflight: int = 4, out: str = "embedding", tolerant: bool = False) -> DataFrame:
    """Adds the vectors. For a remote provider every distinct text is sent once (A16), by at
    most `inflight` tasks at a time (A17); local providers are cheaper than that shuffle."""
    if not embedder.remote:
        return rows.withColumn(out, vectors_for(F.col(text), embedder, tolerant))
    digest = F.sha2(text, 256)
    distinct = rows.groupBy(digest.alias("_digest")).agg(F.first(text).alias("_text"))
    known = distinct.repartition(inflight).select(
        "_digest", vectors_for(F.col("_text"), embedder, tolerant).alias(out))
    return rows.withColumn("_digest", digest).join(known, "_digest").drop("_digest")

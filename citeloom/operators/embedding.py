"""The embedder port: texts to vectors, by a model that is loaded once in each worker."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import IndexMismatchError

#: Models of this worker's process by their id: a worker runs many tasks, and loads a model for the first of them.
_LOADED: dict[str, Callable[[list[str]], list[list[float]]]] = {}


class Embedder(Protocol):
    """A port. model_id and dimensions are known without loading anything; 0 dimensions are no vectors at all."""

    model_id: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class NullEmbedder:
    """The default: there are no vectors, and no index."""

    model_id, dimensions = "null", 0

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[] for _ in texts]


class LoadedEmbedder:
    """A model behind a loader, which is called where the first text is embedded, on the driver or in a worker, and once in each."""

    def __init__(self, model_id: str, dimensions: int, load: Callable[[], Callable[[list[str]], list[list[float]]]]):
        self.model_id, self.dimensions, self.load = model_id, dimensions, load

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.model_id not in _LOADED:
            _LOADED[self.model_id] = self.load()
        return _LOADED[self.model_id](texts)


class HashEmbedder:
    """Words hashed to signed dimensions, as a unit vector: needs no model, and texts of common words are near. The same everywhere."""

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.model_id = dimensions, f"hash-{dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in re.findall(r"[^\W_]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[(h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


def checked(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """The port's vectors: one for each text, of the port's width, or an error."""
    vectors = [[float(x) for x in v] for v in embedder.embed(texts)]
    if len(vectors) != len(texts) or any(len(v) != embedder.dimensions for v in vectors):
        raise IndexMismatchError(f"{embedder.model_id} gave {len(vectors)} vectors of {sorted({len(v) for v in vectors})} dimensions for {len(texts)} texts, not of {embedder.dimensions}")
    return vectors


def missing(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, embedding, embedding_model) of chunks with text that have no vector, or another model's."""
    stale = F.col("embedding").isNull() | (F.col("embedding_model") != embedder.model_id)
    todo = chunks.where(stale & (F.length(F.btrim("text")) > 0)).select("chunk_id", "version_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "version_id": b["version_id"], "embedding": checked(embedder, list(b["text"])), "embedding_model": embedder.model_id})

    return todo.mapInPandas(run, "chunk_id string, version_id string, embedding array<float>, embedding_model string")

"""The store's chunks in their indexes: what was added and what went since the last time, found by keys."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import embedding, vector_index
from ..operators.text_index import TextIndex
from .pointers import Pointers
from .store import Store


class Indexes:
    """A full-text index that is kept up chunk by chunk, and a vector index that is built anew when vectors came or went."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.texts = TextIndex(spark, f"{self.folder}/text")
        self.pointers = Pointers(spark, f"{self.folder}/_vectors")

    def refresh(self, store: Store, embedder: embedding.Embedder | None = None) -> None:
        """Chunk ids follow from content, so an id that is in both has not changed. Nothing is written if nothing has."""
        chunks, have = store.table("chunk"), self.texts.texts().select("chunk_id")
        added = chunks.join(have, "chunk_id", "left_anti").select("chunk_id", "text")
        removed = have.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
        if not added.isEmpty() or not removed.isEmpty():
            self.texts.update(added, removed)
        if embedder is not None and embedder.dimensions:
            self._vectors(store, embedder)

    def _vectors(self, store: Store, embedder: embedding.Embedder) -> None:
        now = self.vectors()
        chunks = store.table("chunk").where((F.col("embedding_model") == embedder.model_id) & F.col("embedding").isNotNull())
        if now is not None and now.model_id == embedder.model_id:
            ids = now.table().select("chunk_id")
            moved = chunks.select("chunk_id").join(ids, "chunk_id", "left_anti").count() + ids.join(chunks.select("chunk_id"), "chunk_id", "left_anti").count()
            if moved == 0:
                return
        folder = f"{self.folder}/vectors-{uuid.uuid4().hex}"
        if vector_index.build(chunks, folder, embedder.model_id) is None:
            return
        number, old = self.pointers.latest()
        if self.pointers.create(number + 1, {"folder": folder}) and old is not None:
            fs, path = self.pointers.fs(old["folder"])
            fs.delete(path, True)

    def vectors(self) -> vector_index.VectorIndex | None:
        found = self.pointers.latest()[1]
        return vector_index.load(self.spark, found["folder"]) if found else None

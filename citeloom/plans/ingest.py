"""Ingest of a source into the store: one commit, and nothing new the second time."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import version_id
from ..operators import chunking, embedding, graph, obligations, versions
from ..sources import issuance, manifest
from ..sources.shared import dropped, written
from .store import Change, Store, created

log = logging.getLogger(__name__)
#: Groups of suspected duplicates that an answer tells of at most.
TOLD = 1_000


@dataclass(frozen=True)
class Ingested:
    documents_created: int
    references_created: int
    self_references_skipped: int
    suspected_duplicates: list[list[str]]


@dropped()
def ingest_manifest(store: Store, path: str, filename: str) -> Ingested:
    """Documents, external names, edges and provenance of a manifest."""
    spark, t = store.spark, store.tables()
    rows = written(manifest.read(spark, path), "manifest")
    c = manifest.corpus(rows)
    slugs = written(graph.manifest_slugs(c.names, t["document"].select("name", "slug")), "slugs")
    new = slugs.select("slug", "name")
    edges = written(graph.edges_by_slug(c.edges, slugs), "edges")
    source = f"manifest:{filename}"
    described = rows.select("name").distinct().join(slugs, "name").select(F.lit(source).alias("source_id"), "slug")
    made = created(t["document"], new, ("slug",)).first()["created"]
    linked = created(t["references_edge"], edges, ("source_slug", "target_slug")).first()["created"]
    skipped = c.self_references.first()["n"]
    twice = [r.names for r in manifest.suspected_duplicates(c.names).orderBy("canonical").limit(TOLD).collect()]
    store.change(
        {
            "document": Change(upsert=new),
            "references_edge": Change(insert=edges),  # both ends are among the slugs
            "source": Change(upsert=spark.createDataFrame([(source, "manifest", filename)], t["source"].schema)),
            "describes": Change(insert=described),
        }
    )
    return Ingested(made, linked, skipped, twice)


@dropped()
def ingest_pages(store: Store, pages, filename: str, uri: str, checksum: str) -> str:
    """One issuance given as pages (doc, page_no, text): document, edges, edition and chunks; the edition's id."""
    spark, t = store.spark, store.tables()
    found = issuance.documents(pages).first()
    if found is None or found["name"] is None:
        raise manifest.SourceError(f"{filename!r} has no recognisable header")
    names = spark.createDataFrame([(found["name"], 0), *[(r, i + 1) for i, r in enumerate(found["references"])]], "name string, position int")
    slugs = written(graph.batch_slugs(names, t["document"].select("name", "slug")), "slugs")
    own = slugs.where(F.col("name") == found["name"]).first()["slug"]
    edges = slugs.where(F.col("slug") != own).select(F.lit(own).alias("source_slug"), F.col("slug").alias("target_slug"))
    edition = spark.range(1).select(F.lit(own).alias("slug"), F.lit(found["effective_date"]).cast("date").alias("d"), F.lit(checksum).alias("checksum"), F.lit(uri).alias("source_uri"), F.current_timestamp().alias("ingested_at"))
    edition = edition.select(version_id(F.col("slug"), F.col("d"), F.col("checksum")).alias("version_id"), "slug", F.date_format("d", "yyyy-MM-dd").alias("effective_date"), "checksum", "source_uri", "ingested_at")
    ident = edition.first()["version_id"]
    new = written(chunking.chunks(pages.select("doc", F.lit(ident).alias("version_id"), "page_no", "text")), "chunks")
    if new.isEmpty():
        raise manifest.SourceError(f"{filename!r} has no text")
    source = f"document:{filename}"
    known = slugs.select("slug", "name")

    def changes(t: dict[str, DataFrame]) -> dict[str, Change]:
        versions.merged(t["document_version"], edition, t["document"].unionByName(known))  # conflicts raise
        return {
            "document": Change(insert=known),
            "references_edge": Change(insert=edges),
            "source": Change(upsert=spark.createDataFrame([(source, "document", filename)], t["source"].schema)),
            "describes": Change(insert=spark.createDataFrame([(source, own)], t["describes"].schema)),
            "document_version": Change(insert=edition),
            "chunk": Change(delete=spark.createDataFrame([(ident,)], "version_id string"), upsert=new),
        }

    store.change(changes)
    return ident


def ingest(store: Store, filename: str, folder: str):
    """A source of the data folder, by its kind."""
    path = manifest.resolve(filename, folder)
    if not manifest.is_document(path):
        return ingest_manifest(store, path, filename)
    pages = written(issuance.pages_of(store.spark, path), "pages")
    return ingest_pages(store, pages.drop("checksum"), filename, path, pages.first()["checksum"])


@dataclass(frozen=True)
class Settings:
    """Limits and places; from_env() reads each from the variable of its name in capitals, and refuses one of the wrong kind."""

    data_dir: str = "data"
    graph_render_cap: int = graph.RENDER_CAP
    query_row_cap: int = 1000
    query_timeout_seconds: float = 10.0
    auto_ingest: str = ""
    job_timeout_seconds: float = 1_800.0
    result_ttl_seconds: int = 86_400
    extractor: str = "null"
    extractor_url: str = ""
    extractor_model: str = ""
    embedder: str = "null"
    embedding_dimensions: int = 64

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None) -> Settings:
        env, found = os.environ if env is None else env, {}
        for f in fields(Settings):
            if (text := env.get(f.name.upper())) is not None:
                try:
                    found[f.name] = type(f.default)(text)
                except ValueError as e:
                    raise ValueError(f"{f.name.upper()} is {text!r}, no {type(f.default).__name__}") from e
        return Settings(**found)

    def extractor_port(self) -> obligations.Extractor:
        """The extractor that is named: null, modal or http."""
        if self.extractor == "http":
            if not self.extractor_url or not self.extractor_model:
                raise ValueError("an http extractor needs EXTRACTOR_URL and EXTRACTOR_MODEL")
            return obligations.HttpExtractor(self.extractor_url, self.extractor_model)
        ports = {"null": obligations.NullExtractor, "modal": obligations.ModalExtractor}
        if self.extractor not in ports:
            raise ValueError(f"there is no extractor {self.extractor!r}")
        return ports[self.extractor]()

    def embedder_port(self) -> embedding.Embedder:
        """The embedder that is named: null or hash."""
        if self.embedder not in ("null", "hash"):
            raise ValueError(f"there is no embedder {self.embedder!r}")
        return embedding.HashEmbedder(self.embedding_dimensions) if self.embedder == "hash" else embedding.NullEmbedder()


def auto_ingest(store: Store, settings: Settings) -> bool:
    """Ingests the named source at start if the store is empty; a source that cannot be read is logged, not fatal."""
    if not settings.auto_ingest or not store.is_empty():
        return False
    try:
        ingest(store, settings.auto_ingest, settings.data_dir)
        return True
    except manifest.SourceError as e:
        log.warning("not ingested: %s", e)
        return False

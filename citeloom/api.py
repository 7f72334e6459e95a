"""What a user of the service can ask for, one method each, over a store. Answers are DataFrames or small records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import base_slug, suffixed, uri_path
from .operators import changes, embedding, graph, links, obligations, search, versions
from .plans import indexes, ingest, rebuild, sql, store
from .plans.ingest import Settings
from .sources import issuance


class Service:
    """The actor of a decision is an argument: who calls is for the layer above to know."""

    def __init__(self, db: store.Store, settings: Settings | None = None, extractor: obligations.Extractor | None = None, embedder: embedding.Embedder | None = None, indexes: indexes.Indexes | None = None):
        self.db, self.settings, self.extractor, self.embedder = db, settings or Settings(), extractor or obligations.NullExtractor(), embedder or embedding.NullEmbedder()
        self.indexes, self.jobs = indexes, rebuild.Jobs(db, self.settings.job_timeout_seconds, self.settings.result_ttl_seconds)

    def health(self) -> dict:
        return {"status": "ok", "spark": self.db.spark.version}

    def ingest(self, filename: str):
        made = ingest.ingest(self.db, filename, self.settings.data_dir)
        self.index()
        return made

    def index(self) -> None:
        """Brings vectors and indexes up to date with the store's chunks."""
        rebuild.embed(self.db, self.embedder)
        if self.indexes is not None:
            self.indexes.refresh(self.db, self.embedder)

    def reset(self) -> dict[str, int]:
        return self.db.clear()

    def _documents(self) -> DataFrame:
        return graph.with_external(self.db.table("document"), self.db.table("describes"))

    def documents(self) -> DataFrame:
        return graph.adjacency(self._documents(), self.db.table("references_edge"), self.db.table("document_version")).orderBy("slug")

    def document(self, slug: str) -> DataFrame:
        self._must_exist(slug)
        return self.documents().where(F.col("slug") == slug)

    def _must_exist(self, slug: str) -> None:
        if self.db.at("document", slug).isEmpty():
            raise graph.NotFoundError(slug)

    def create_document(self, name: str, source: str = "api") -> str:
        """A new document; one that is stored keeps its slug, a newcomer to a taken one gets a suffix."""
        name = name.strip()
        if not name:
            raise ValueError("a document has a name")
        t = self.db.tables()
        if not t["document"].where(F.col("name") == name).isEmpty():
            raise versions.ConflictError(name)
        spark = self.db.spark
        slug, other = spark.range(1).select(base_slug(F.lit(name)), suffixed(base_slug(F.lit(name)), F.lit(name))).first()
        if not t["document"].where(F.col("slug") == slug).isEmpty():
            slug = other
        row = lambda table, *values: spark.createDataFrame([values], t[table].schema)
        ident = f"api:{source}"
        new = {"document": store.Change(add=row("document", slug, name)), "source": store.Change(upsert=row("source", ident, "api", source)), "describes": store.Change(insert=row("describes", ident, slug))}
        self.db.change(new)
        return slug

    def delete_document(self, slug: str) -> None:
        self._must_exist(slug)
        self.db.change(lambda t: store.deletion(t, slug))

    def add_reference(self, slug: str, target: str) -> None:
        self._must_exist(slug)
        self._must_exist(target)
        self.db.change({"references_edge": store.Change(insert=store.new_reference(self.db.spark, slug, target))})

    def remove_reference(self, slug: str, target: str) -> None:
        gone = self.db.spark.createDataFrame([(slug, target)], "source_slug string, target_slug string")
        self.db.change({"references_edge": store.Change(delete=gone)})

    def versions(self, slug: str) -> DataFrame:
        """Editions, oldest first, with the one each supersedes; none for an unknown document."""
        return versions.chain(self.db.at("document_version", slug)).orderBy(*versions.oldest_first())

    def chunks(self, slug: str, version_id: str | None = None) -> DataFrame:
        """Chunks of an edition, by default the newest, in reading order."""
        own = self.db.at("document_version", slug)
        own = own.where(F.col("version_id") == version_id) if version_id else versions.newest(own)
        return self.db.table("chunk").join(own.select("version_id"), "version_id", "left_semi").orderBy("ordinal")

    def graph(self, include_external: bool = False, expand: str | None = None, limit: int | None = None) -> graph.View:
        return graph.view(self._documents(), self.db.table("references_edge"), include_external, expand, self.settings.graph_render_cap if limit is None else limit)

    def query(self, text: str) -> sql.Result:
        """Read-only SQL over the store's tables, by their names."""
        return sql.run(self.db.spark, text, self.settings.query_row_cap, self.settings.query_timeout_seconds, self.db.tables())

    def pages_of(self, version_id: str) -> DataFrame:
        """Pages of an edition's stored file, found by the path of its source."""
        row = self.db.table("document_version").where(F.col("version_id") == version_id).select(uri_path(F.col("source_uri")).alias("path")).first()
        if row is None or not row["path"]:
            raise graph.NotFoundError(version_id)
        return issuance.pages_of(self.db.spark, f"file://{row['path']}")

    def rebuild(self, version_id: str, pages: DataFrame, wait: float | None = None) -> str:
        """Begins a rebuild in the background and returns its run; with `wait`, after that many seconds at most if it has not ended."""
        run = self.jobs.submit(version_id, pages, self.extractor)
        if wait is not None:
            self.jobs.wait(run, wait)
        return run

    def rebuild_status(self, run_id: str) -> DataFrame:
        return self.jobs.status(run_id)

    def cancel_rebuild(self, run_id: str) -> None:
        self.jobs.cancel(run_id)

    def set_authority(self, version_id: str, name: str) -> str:
        """Makes an authority the issuer of an edition; the authority's slug."""
        authority = versions.named(self.db.spark.createDataFrame([(name,)], "name string"))
        slug = authority.first()["slug"]
        given = self.db.spark.createDataFrame([(version_id, slug)], "version_id string, authority_slug string")

        def changes(t: dict[str, DataFrame]) -> dict[str, store.Change]:
            edge = versions.issued(t["document_version"], t["authority"].unionByName(authority), given)
            if edge.isEmpty():
                raise graph.NotFoundError(version_id)
            return {"authority": store.Change(insert=authority), "issued_by": store.Change(insert=edge)}

        self.db.change(changes)
        return slug

    def add_entity(self, name: str, kind: str) -> str:
        """An entity that obligations may apply to; its slug. One that is stored stays as it is."""
        entity = versions.named(self.db.spark.createDataFrame([(name,)], "name string"), kind)
        self.db.change({"entity": store.Change(insert=entity)})
        return entity.first()["slug"]

    def sources(self) -> DataFrame:
        """How many documents each source describes, the most first."""
        return graph.by_source(self.db.table("source"), self.db.table("describes"))

    def review_queue(self, limit: int = links.QUEUE_LIMIT) -> DataFrame:
        return links.review_queue(self.db.table("implements_proposed"), self.db.table("link_decision"), limit)

    def review(self, source: str, target: str, verdict: str, actor: str, rationale: str = "") -> dict[str, int]:
        return rebuild.decide(self.db, source, target, verdict, actor, rationale)

    def triage(self, to_version_id: str, from_version_id: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Ranked clauses of ours, and the counts of changes; by default against the edition before. The changes are stored."""
        t = self.db.tables()
        found = t["document_version"].where(F.col("version_id") == to_version_id).first()
        if found is None:
            raise graph.NotFoundError(to_version_id)
        if from_version_id is None:
            before = self.versions(found["slug"]).where(F.col("version_id") == to_version_id).first()["supersedes"]
            if before is None:
                raise graph.NotFoundError(f"{to_version_id} has no edition before it")
            from_version_id = before
        elif t["document_version"].where(F.col("version_id") == from_version_id).isEmpty():
            raise graph.NotFoundError(from_version_id)
        changed = rebuild.keep_changes(self.db, changes.diff(t["obligation"], from_version_id, to_version_id), from_version_id, to_version_id)
        rows = changes.triage(changed, t["implements"], t["obligation"], t["anchored_in"], t["chunk"], t["document_version"], t["document"])
        return rows, changes.unlinked(changed, t["implements"])

    def ask(self, question: str) -> search.Answer:
        texts, vectors = (self.indexes.texts, self.indexes.vectors()) if self.indexes is not None else (None, None)
        return search.ask(self.db.tables(), question, self.embedder, texts=texts, vectors=vectors)

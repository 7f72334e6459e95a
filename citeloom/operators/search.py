"""Search over chunks: full text, vectors, approved links, their fusion by rank, templates and answers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import truncated
from ..sources.shared import written
from .obligations import primary_anchor

# Ranks are fused as 1 / (60 + rank); legs in order; rows of an answer.
RRF, LEGS, ROWS, LIMIT, MOST = 60, ("vector", "fulltext", "graph"), 10, 10, 500
K1, B = 1.2, 0.75
NOTHING = "The corpus does not state an answer to this question."
GROUNDED = "grounded_passages"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a query has no syntax, so all of it is terms."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(chunks: DataFrame, query: str, k: int, ident: str = "chunk_id", text: str = "text") -> DataFrame:
    """(id, score) of the k chunks that score best for any of the query's words.

    Each text is read once: a row of counts of the query's words is written for it, and totals and
    scores come from these rows.
    """
    terms = sorted({t for t in re.findall(r"[^\W_]+", query.lower())})
    if not terms:
        return chunks.select(F.col(ident), F.lit(0.0).alias("score")).limit(0)
    t = tokens(F.coalesce(F.col(text), F.lit("")))  # a null text has no words, and counts as a text
    counted = chunks.select(ident, t.alias("t"))
    tf = [(F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    counted = written(counted.select(ident, F.size("t").alias("length"), *tf), "counts")
    totals = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one")  # totals are one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.select(ident, score.alias("score")).orderBy(F.desc("score"), ident).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, summed in double; null if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


class IndexMismatchError(ValueError):
    """Vectors were made by another model, or have another width, than the query's."""


def nearest(chunks: DataFrame, vector: list[float], k: int, ident: str = "chunk_id", embedding: str = "embedding", index: DataFrame | None = None, model_id: str | None = None) -> DataFrame:
    """(id, score) of the k vectors of the highest cosine, exact; the index's model and width must be the query's."""
    if index is not None and (row := index.first()) is not None and ((model_id and row.model_id != model_id) or row.dimensions != len(vector)):
        raise IndexMismatchError(f"the index is of {row.model_id} with {row.dimensions} dimensions")
    query = F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.where(F.size(embedding) == len(vector)).select(ident, cosine(F.col(embedding), query).alias("score"))
    return scored.where("score IS NOT NULL").orderBy(F.desc("score"), ident).limit(k)


def ranked(scored: DataFrame, leg: str, ident: str = "chunk_id") -> DataFrame:
    """(leg, id, rank) of a top-k result, from 1; the window orders the k rows of the result only."""
    return scored.select(F.lit(leg).alias("leg"), ident, F.row_number().over(W.orderBy(F.desc("score"), ident)).alias("rank"))


def seeds(legs: DataFrame, limit: int, ident: str = "chunk_id") -> DataFrame:
    """First-seen ids over the legs in their order."""
    place = F.array_position(F.array(*map(F.lit, LEGS)), F.col("leg")) * 1_000_000 + F.col("rank")
    return legs.groupBy(ident).agg(F.min(place).alias("place")).orderBy("place", ident).limit(limit).select(ident, F.row_number().over(W.orderBy("place", ident)).alias("seed_rank"))


def graph_leg(seed: DataFrame, anchors: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """Chunks one approved link away from the seeds, in either direction, by the best seed's rank; all anchors count, seeds do not."""
    either = links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(links.select(F.col("target_id").alias("a"), F.col("source_id").alias("b")))
    near = seed.join(anchors, "chunk_id").select("seed_rank", F.col("obligation_id").alias("a")).join(either, "a").select("seed_rank", F.col("b").alias("obligation_id")).join(anchors, "obligation_id")
    found = near.join(seed.select("chunk_id"), "chunk_id", "left_anti").groupBy("chunk_id").agg(F.min("seed_rank").alias("best"))
    return found.orderBy("best", "chunk_id").limit(k).select(F.lit("graph").alias("leg"), "chunk_id", F.row_number().over(W.orderBy("best", "chunk_id")).alias("rank"))


def fuse(legs: DataFrame, limit: int, ident: str = "chunk_id") -> DataFrame:
    """(id, score, legs) of the best by summed 1 / (60 + rank), with the legs that found each."""
    place = F.array_position(F.array(*map(F.lit, LEGS)), F.col("leg"))
    found = legs.groupBy(ident).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"), F.array_sort(F.collect_set(F.struct(place.alias("p"), "leg"))).alias("l"))
    return found.select(ident, "score", F.transform("l", lambda x: x["leg"]).alias("legs")).orderBy(F.desc("score"), ident).limit(limit)


def hydrate(hits: DataFrame, chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with text and document, in order of rank; ids that no longer exist drop out."""
    full = hits.join(chunks.select("chunk_id", "version_id", "text", "page", "section_path"), "chunk_id").join(versions.select("version_id", "slug"), "version_id").join(documents.select("slug", F.col("name").alias("document")), "slug")
    return full.select("chunk_id", "score", "legs", "document", "section_path", "page", "text").orderBy(F.desc("score"), "chunk_id")


def retrieve(t: dict[str, DataFrame], query: str, embedder=None, limit: int = LIMIT, texts=None, vectors=None) -> DataFrame:
    """Hybrid retrieval over the store's tables: each leg brings max(4 * limit, 20) candidates.

    embedder: the port of operators/embedding.py, whose model must be that of the stored vectors;
    without one, or of no dimensions, there is no vector leg. texts and vectors are indexes of the
    chunks, operators/text_index.py and operators/vector_index.py; without them all chunks are read.
    """
    if not query.strip():
        raise ValueError("the query is blank")
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be 1 to {MOST}")
    k = max(4 * limit, 20)
    legs = ranked(texts.search(query, k) if texts is not None else bm25(t["chunk"], query, k), "fulltext")
    if embedder is not None and embedder.dimensions:
        vector = embedder.embed([query])[0]
        near = vectors.near(vector, k, embedder.model_id) if vectors is not None else nearest(t["chunk"], vector, k, index=t.get("embedding_index"), model_id=embedder.model_id)
        legs = ranked(near, "vector").unionByName(legs)
    legs = legs.unionByName(graph_leg(seeds(legs, k), t["anchored_in"], t["implements"], k))
    return hydrate(fuse(legs, limit), t["chunk"], t["document_version"], t["document"])


@dataclass(frozen=True)
class Selection:
    name: str
    parameters: dict[str, str] = field(default_factory=dict)


# The three shapes of questions that have a template, tried in this order.
SHAPES = (
    ("changes_for_document", "document", re.compile(r"what (?:has )?changed (?:in|to)\s+(.+?)\s*\??$", re.I)),
    ("implements_for_document", "document", re.compile(r"what does\s+(.+?)\s+implement\s*\??$", re.I)),
    ("obligations_for_actor", "actor", re.compile(r"^(?:what obliges|what are the (?:duties|obligations|responsibilities) of|who must|who shall)\s+(.+?)\s*\??$", re.I)),
)


def select_template(question: str | None) -> Selection:
    """The template of a question's shape, or grounded passages."""
    text = (question or "").strip()
    for name, parameter, shape in SHAPES:
        if m := shape.search(text):
            return Selection(name, {parameter: m[1]})
    return Selection(GROUNDED)


def _holds(column: Column, needle: str) -> Column:
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lower(F.lit(needle)))


def _cited(rows: DataFrame, t: dict[str, DataFrame], document: str = "document") -> DataFrame:
    """Rows of (obligation_id, statement, modality, document) with the primary anchor's citation."""
    return rows.select("obligation_id", "statement", "modality", document).join(primary_anchor(t["anchored_in"], t["chunk"]), "obligation_id").select("statement", "modality", document, "section_path", "page", F.col("text").alias("quote"))


def _documents(t: dict[str, DataFrame]) -> DataFrame:
    return t["document_version"].select("version_id", "slug").join(t["document"].select("slug", F.col("name").alias("document")), "slug").drop("slug")


def obligations_for_actor(t: dict[str, DataFrame], actor: str, limit: int = ROWS) -> DataFrame:
    found = t["obligation"].where(_holds(F.col("statement"), actor) | _holds(F.col("actor"), actor)).join(_documents(t), "version_id")
    return _cited(found, t).orderBy("document", "page", "statement").limit(limit)


def implements_for_document(t: dict[str, DataFrame], document: str, limit: int = ROWS) -> DataFrame:
    own = _documents(t).where(_holds(F.col("document"), document)).select("version_id")
    ours = t["obligation"].join(own, "version_id", "left_semi").select(F.col("obligation_id").alias("source_id"))
    higher = t["implements"].join(ours, "source_id").select(F.col("target_id").alias("obligation_id")).join(t["obligation"], "obligation_id").join(_documents(t), "version_id")
    return _cited(higher, t).orderBy("document", "page", "statement").limit(limit)


def changes_for_document(t: dict[str, DataFrame], document: str, limit: int = ROWS) -> DataFrame:
    own = _documents(t).where(_holds(F.col("document"), document)).withColumnRenamed("version_id", "to_version_id")
    found = t["change"].drop("modality").join(own, "to_version_id").join(t["obligation"].select("obligation_id", "modality"), "obligation_id")
    return _cited(found.withColumn("statement", F.concat_ws(": ", "kind", "statement")), t).orderBy("page", "statement").limit(limit)


TEMPLATES = {f.__name__: f for f in (obligations_for_actor, implements_for_document, changes_for_document)}


@dataclass(frozen=True)
class Answer:
    text: str
    citations: list[dict]
    template_used: str


def compose(citations: list[dict]) -> str:
    """An answer made of its citations and nothing else."""
    if not citations:
        return NOTHING
    return "\n".join(["The corpus states:", *(f'— "{c["quote"]}" ({c["document"]}, {"/".join(c["section_path"])}, p. {c["page"]})' for c in citations)])


def ask(t: dict[str, DataFrame], question: str, embedder=None, limit: int = ROWS, texts=None, vectors=None) -> Answer:
    """A template's rows, or else retrieved passages, as a cited answer; at most `limit` rows reach the driver."""
    if not question or not question.strip() or len(question) > 1000:
        raise ValueError("a question has 1 to 1000 characters")
    chosen = select_template(question)
    rows: list[dict] = []
    if chosen.name in TEMPLATES:
        found = TEMPLATES[chosen.name](t, limit=limit, **chosen.parameters)
        said = F.coalesce(F.nullif(F.col("statement"), F.lit("")), F.col("quote"))  # the clause; its chunk where there is none
        rows = [r.asDict() for r in found.withColumn("quote", truncated(said)).collect()]
    used = chosen.name if rows else GROUNDED
    if not rows:
        rows = [r.asDict() for r in retrieve(t, question, embedder, limit, texts, vectors).withColumn("quote", truncated(F.col("text"))).collect()]
    citations = [{k: r[k] for k in ("document", "section_path", "page", "quote")} for r in rows]
    return Answer(compose(citations), citations, used)

"""The citation graph: slugs, degrees, views with reported truncation, adjacency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_slug, suffixed

RENDER_CAP = 300


class NotFoundError(LookupError):
    """A document that a view was asked for does not exist."""


def manifest_slugs(names: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(name, slug) for distinct names: every contender of a contested base gets a suffix, whatever the order.

    stored (name, slug) names keep their slug; a new bare slug that one of them has gets a suffix.
    """
    new = names.select("name").distinct()
    if stored is not None:
        new = new.join(stored, "name", "left_anti")
    bases = new.select("name", base_slug(F.col("name")).alias("base"))
    crowd = bases.groupBy("base").agg(F.count("*").alias("n"))
    out = bases.join(crowd, "base").select("name", F.when(F.col("n") > 1, suffixed(F.col("base"), F.col("name"))).otherwise(F.col("base")).alias("slug"))
    if stored is None:
        return out
    taken = stored.select("slug").distinct().withColumn("taken", F.lit(True))
    out = out.join(taken, "slug", "left").select("name", F.when(F.col("taken"), suffixed(F.col("slug"), F.col("name"))).otherwise(F.col("slug")).alias("slug"))
    return out.unionByName(stored.join(names.select("name").distinct(), "name", "left_semi").select("name", "slug"))


def batch_slugs(names: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, slug) for (name, position): the first new name in order keeps a bare base that nothing stored has."""
    new = names.groupBy("name").agg(F.min("position").alias("position")).join(stored, "name", "left_anti").withColumn("base", base_slug(F.col("name")))
    new = new.join(stored.select(F.col("slug").alias("base")).distinct().withColumn("taken", F.lit(True)), "base", "left")
    first = F.row_number().over(W.partitionBy("base").orderBy("position")) == 1
    out = new.select("name", F.when(first & F.col("taken").isNull(), F.col("base")).otherwise(suffixed(F.col("base"), F.col("name"))).alias("slug"))
    return out.unionByName(stored.join(names, "name", "left_semi").select("name", "slug"))


def edges_by_slug(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """(source_slug, target_slug) for named edges; an edge of which an end has no slug drops out."""
    return edges.join(slugs.select(F.col("name").alias("source"), F.col("slug").alias("source_slug")), "source").join(slugs.select(F.col("name").alias("target"), F.col("slug").alias("target_slug")), "target").select("source_slug", "target_slug").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(slug, other): each edge as seen from either end."""
    return edges.select(F.col("source_slug").alias("slug"), F.col("target_slug").alias("other")).unionAll(edges.select(F.col("target_slug").alias("slug"), F.col("source_slug").alias("other")))


def degrees(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """documents with degree: edges in either direction over the whole graph, 0 for isolated ones."""
    counted = both_ways(edges).groupBy("slug").agg(F.count("*").alias("degree"))
    return documents.join(counted, "slug", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def with_external(documents: DataFrame, describes: DataFrame) -> DataFrame:
    """documents with is_external: no source describes it. A view, so that it cannot drift."""
    known = describes.select("slug").distinct().withColumn("__known", F.lit(True))
    return documents.drop("is_external").join(known, "slug", "left").withColumn("is_external", F.col("__known").isNull()).drop("__known")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    have = nodes.select("slug")
    return edges.join(have.withColumnRenamed("slug", "source_slug"), "source_slug", "left_semi").join(have.withColumnRenamed("slug", "target_slug"), "target_slug", "left_semi").select("source_slug", "target_slug")


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too."""
    back = edges.select(F.col("target_slug").alias("source_slug"), F.col("source_slug").alias("target_slug"))
    return edges.join(back, ["source_slug", "target_slug"], "left_semi")


@dataclass(frozen=True)
class View:
    """Nodes, the edges among them, and how many nodes there were to show; nothing is left out silently."""

    nodes: DataFrame
    edges: DataFrame
    total_nodes: int
    returned_nodes: int

    @property
    def truncated(self) -> bool:
        return self.returned_nodes < self.total_nodes


def corpus_nodes(documents: DataFrame) -> DataFrame:
    return documents.where("NOT is_external")


def candidates(documents: DataFrame, edges: DataFrame, expand: str | None = None) -> DataFrame:
    """External documents that a view may add, with their degree: all of them, or the neighbours of one document."""
    outside = documents.where("is_external")
    if expand:
        near = both_ways(edges).where(F.col("slug") == expand).select(F.col("other").alias("slug")).distinct()
        outside = outside.join(near, "slug", "left_semi")
    return degrees(outside, edges)


def ranked_nodes(documents: DataFrame, edges: DataFrame, budget: int | None, expand: str | None = None) -> DataFrame:
    """The corpus, and external documents by degree, then slug, as many as the budget allows; lazy, a top-k."""
    more = candidates(documents, edges, expand)
    if budget is not None:
        more = more.orderBy(F.desc("degree"), "slug").limit(budget)
    return corpus_nodes(documents).select("slug", "name", "is_external").unionByName(more.select("slug", "name", "is_external"))


def view(documents: DataFrame, edges: DataFrame, include_external: bool = False, expand: str | None = None, limit: int | None = RENDER_CAP) -> View:
    """A view of the graph; limit 0 or None is no limit, an empty `expand` is none, an unknown one an error."""
    if limit is not None and limit < 0:
        raise ValueError("limit is negative")
    if expand and documents.where(F.col("slug") == expand).isEmpty():
        raise NotFoundError(expand)
    own = corpus_nodes(documents)
    own_n = own.count()
    if not include_external and not expand:
        nodes, total = own.select("slug", "name", "is_external"), own_n
        returned = total
    else:
        one = None if include_external else expand
        outside = candidates(documents, edges, one).count()
        total = own_n + outside
        budget = max(0, limit - own_n) if limit else None
        nodes, returned = ranked_nodes(documents, edges, budget, one), own_n + (outside if budget is None else min(budget, outside))
    return View(nodes, induced(edges, nodes), total, returned)


def adjacency(documents: DataFrame, edges: DataFrame, versions: DataFrame) -> DataFrame:
    """documents with sorted references and referenced_by, and version_count; each is aggregated before it is joined."""
    out = edges.groupBy(F.col("source_slug").alias("slug")).agg(F.sort_array(F.collect_set("target_slug")).alias("references"))
    into = edges.groupBy(F.col("target_slug").alias("slug")).agg(F.sort_array(F.collect_set("source_slug")).alias("referenced_by"))
    count = versions.groupBy("slug").agg(F.count_distinct("version_id").alias("version_count"))
    none = F.array().cast("array<string>")
    joined = documents.join(out, "slug", "left").join(into, "slug", "left").join(count, "slug", "left")
    return joined.withColumns({"references": F.coalesce("references", none), "referenced_by": F.coalesce("referenced_by", none), "version_count": F.coalesce("version_count", F.lit(0).cast("bigint"))})


def named(listing: DataFrame, needle: str) -> DataFrame:
    """Rows whose name holds a needle, without regard to case and outer spaces."""
    return listing.where(F.contains(F.lower("name"), F.lower(F.btrim(F.lit(needle)))))


def by_source(sources: DataFrame, describes: DataFrame) -> DataFrame:
    """(kind, filename, documents) of each source, by how many documents it describes; a source of none has 0."""
    n = describes.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("documents"))
    return sources.join(n, "id", "left").select("kind", "filename", F.coalesce("documents", F.lit(0)).alias("documents")).orderBy(F.desc("documents"), "kind", "filename")


def with_editions(listing: DataFrame) -> DataFrame:
    """Documents of a listing that have editions."""
    return listing.where("version_count > 0")


def in_degree(listing: DataFrame) -> DataFrame:
    """A listing with cited: by how many documents each is referenced."""
    return listing.withColumn("cited", F.size("referenced_by"))


def labelled(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, source, target): an edge's key and the names of its ends, or their slugs where a name is not known."""
    name = lambda c, a: documents.select(F.col("slug").alias(c), F.col("name").alias(a))
    found = edges.join(name("source_slug", "s"), "source_slug", "left").join(name("target_slug", "t"), "target_slug", "left")
    return found.select(F.concat_ws(" ", "source_slug", "target_slug").alias("key"), F.coalesce("s", "source_slug").alias("source"), F.coalesce("t", "target_slug").alias("target"))

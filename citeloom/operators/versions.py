"""Editions of documents: identity, conflicts, the chain from newest to oldest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_slug


class ConflictError(ValueError):
    """An edition is stored with other contents."""


def oldest_first() -> list:
    """Undated editions sort oldest; those of one date by when they came, then by id."""
    return [F.coalesce("effective_date", F.lit("")), F.col("ingested_at"), F.col("version_id")]


def chain(versions: DataFrame) -> DataFrame:
    """versions with supersedes: the edition before, by document; null for the oldest."""
    return versions.withColumn("supersedes", F.lag("version_id").over(W.partitionBy("slug").orderBy(*oldest_first())))


def newest(versions: DataFrame) -> DataFrame:
    """The newest edition of each document; an aggregate, so that no document's editions are gathered."""
    key = F.struct(F.coalesce("effective_date", F.lit("")).alias("d"), "ingested_at", F.col("version_id"))
    return versions.groupBy("slug").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "slug"]), key).alias("v")).select("slug", "v.*")


def comparable(versions: DataFrame) -> DataFrame:
    """Editions that have one before them."""
    return chain(versions).where("supersedes IS NOT NULL")


class UnknownDocumentError(LookupError):
    """An edition is of a document that is not stored."""


def merged(stored: DataFrame, new: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """stored and those of new it does not have; an edition stored with another checksum is a conflict, one of an unknown document is refused."""
    if documents is not None:
        lost = new.join(documents, "slug", "left_anti").select("slug").limit(3).collect()
        if lost:
            raise UnknownDocumentError(", ".join(str(r.slug) for r in lost))
    clash = new.alias("n").join(stored.alias("s"), "version_id").where(F.col("n.checksum") != F.col("s.checksum")).select("version_id").limit(3).collect()
    if clash:
        raise ConflictError(", ".join(r.version_id for r in clash))
    return stored.unionByName(new.join(stored, "version_id", "left_anti"))


def issued(versions: DataFrame, authorities: DataFrame, given: DataFrame) -> DataFrame:
    """issued_by edges (version_id, authority_slug) of given ones whose edition and authority are both there, without repeats."""
    known = given.join(versions.select("version_id"), "version_id", "left_semi").join(authorities.select(F.col("slug").alias("authority_slug")), "authority_slug", "left_semi")
    return known.select("version_id", "authority_slug").distinct()


def named(names: DataFrame, kind: str | None = None) -> DataFrame:
    """(slug, name) of authorities, or (slug, name, kind) of entities, from names: the slug follows from the name, the first name in order keeps it."""
    rows = names.select(base_slug(F.btrim("name")).alias("slug"), F.btrim("name").alias("name")).where("name <> ''").groupBy("slug").agg(F.min("name").alias("name"))
    return rows if kind is None else rows.withColumn("kind", F.lit(kind))

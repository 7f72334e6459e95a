"""Tables of the store: their columns, keys, and the check that Spark does not make itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns and unique key of each table. Canonical tables survive a rebuild; derived ones can be dropped.
TABLES: dict[str, tuple[str, tuple[str, ...], str]] = {
    "document": ("slug string, name string", ("slug",), "canonical"),
    "source": ("id string, kind string, filename string", ("id",), "canonical"),
    "describes": ("source_id string, slug string", ("source_id", "slug"), "canonical"),
    "references_edge": ("source_slug string, target_slug string", ("source_slug", "target_slug"), "canonical"),
    "document_version": ("version_id string, slug string, effective_date string, checksum string, source_uri string, ingested_at timestamp", ("version_id",), "canonical"),
    "authority": ("slug string, name string", ("slug",), "canonical"),
    "entity": ("slug string, name string, kind string", ("slug",), "canonical"),
    "issued_by": ("version_id string, authority_slug string", ("version_id", "authority_slug"), "canonical"),
    "chunk": ("chunk_id string, version_id string, text string, page int, section_path array<string>, ordinal int, embedding array<float>, embedding_model string", ("chunk_id",), "derived"),
    "obligation": ("obligation_id string, version_id string, statement string, modality string, actor string, deadline string, conditions string, confidence double, section_path array<string>", ("obligation_id",), "derived"),
    "anchored_in": ("obligation_id string, chunk_id string", ("obligation_id", "chunk_id"), "derived"),
    "implements_proposed": ("source_id string, target_id string, confidence double, rationale string, proposer string", ("source_id", "target_id"), "derived"),
    "implements": ("source_id string, target_id string", ("source_id", "target_id"), "derived"),
    "link_decision": ("key string, source_obligation_id string, target_obligation_id string, verdict string, actor string, rationale string, at timestamp", ("key",), "canonical"),
    "change": ("change_id string, from_version_id string, to_version_id string, obligation_id string, kind string, section_path array<string>, statement string, previous_statement string, modality string, summary string", ("change_id",), "derived"),
    "extraction_cache": ("key string, payload_json string", ("key",), "derived"),
    "embedding_index": ("name string, model_id string, dimensions int", ("name",), "derived"),
    "job": ("run_id string, version_id string, state string, done int, total int, error string, at timestamp", ("run_id", "state", "done"), "derived"),
}

#: The column that writes of a table are scoped by, a function of its key: rows of one value lie together in the store.
PLACES: dict[str, str] = {name: key[0] for name, (_, key, _) in TABLES.items()} | {"describes": "slug", "document_version": "slug", "chunk": "version_id", "obligation": "version_id", "change": "to_version_id"}

MODALITIES = ("SHALL", "MUST", "SHOULD", "MAY")
VERDICTS = ("approve", "reject")


class DuplicateKeyError(ValueError):
    """A table holds a key twice."""


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table][0])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df's columns in the table's order and types; columns it lacks are null."""
    wanted = df.sparkSession.createDataFrame([], TABLES[table][0]).schema
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def assert_unique(df: DataFrame, key: tuple[str, ...], what: str = "table") -> DataFrame:
    """df itself, after one aggregate that finds no key twice."""
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n").limit(3).collect()
    if twice:
        raise DuplicateKeyError(f"{what} holds {', '.join(map(str, map(tuple, twice)))} more than once")
    return df


def checked_modality(modality: Column) -> Column:
    """The modality, or an error for one outside the closed set: values are never coerced."""
    return F.when(modality.isin(*MODALITIES), modality).otherwise(F.raise_error(F.concat(F.lit("unknown modality: "), F.coalesce(modality, F.lit("null")))))


def checked_confidence(confidence: Column) -> Column:
    return F.when((confidence >= 0) & (confidence <= 1), confidence).otherwise(F.raise_error(F.concat(F.lit("confidence outside 0..1: "), F.coalesce(confidence.cast("string"), F.lit("null")))))

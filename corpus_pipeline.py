"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import mixing, near_copies, packing, pii, quality
from citeloom.llm.common import Written, columns
from citeloom.llm.queries import tokenizer_path
from citeloom.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others keep all columns and values.

    Null and empty texts are rejected, repeated rows and null ids judged like others; an empty table stays empty.
    """
    row = F.struct(*columns(docs)).alias("row")
    judged = quality.judge(docs.select(row), spark.read.parquet(f"{sf_dir}/labels.parquet"), "row.doc_id", "row.text")
    return judged.where("kept").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts with 0.8 or more of their shingles of five words in common the row with the smallest id stays.

    SimHashes that differ in few bits propose the first pairs, keys of MinHash those that bits can not; sets are compared whole.
    Texts without words are one class, null ids come last, of repeated rows one stays; columns keep their values.
    """
    return near_copies.deduplicate(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts are replaced by their kind, and n_chars follows; null texts stay null, of 0 characters, and all rows stay."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it, or not at all; texts without words are not taken more than once."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null or empty text is its end id alone, repeated rows are packed each for itself."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's input is dropped once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = Written(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return docs

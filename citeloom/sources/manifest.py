"""Manifests: a CSV of documents and the names they cite, and what follows from it."""

from __future__ import annotations

import ast
from dataclasses import dataclass
from pathlib import PurePath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_name

HEADER = ("Document Name", "References", "Type")


class SourceError(ValueError):
    """A source cannot be read as what it should be."""


def resolve(filename: str, folder: str) -> str:
    """Path of a file right in the data folder; names with folders or leading up are refused."""
    if not filename or filename in (".", "..") or PurePath(filename).name != filename or "\\" in filename:
        raise SourceError(f"{filename!r} is not a bare file name")
    return f"{folder.rstrip('/')}/{filename}"


def is_document(path: str) -> bool:
    """A single document (PDF) rather than a manifest."""
    return path.lower().endswith(".pdf")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal(cells: pd.Series) -> pd.Series:
    def one(cell):
        try:
            found = ast.literal_eval(cell or "")
        except (ValueError, SyntaxError) as e:
            raise SourceError(f"not a list: {(cell or '')[:80]!r}") from e
        if not isinstance(found, (list, tuple)):
            raise SourceError(f"not a list: {cell[:80]!r}")
        return [s for s in (str(x).strip() for x in found) if s]

    return cells.map(one)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, references): one row a document; the header must be exact, a name not blank, a cell a list or tuple, written out. Type is read and dropped."""
    head = spark.read.option("multiLine", True).option("escape", '"').csv(path).limit(1).collect()
    if not head or tuple(c.lstrip("﻿").strip() if c else c for c in head[0]) != HEADER:
        raise SourceError(f"the header is not {','.join(HEADER)}")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema("name string, cell string, kind string").csv(path)
    name = F.btrim(F.regexp_replace(F.coalesce("name", F.lit("")), r"(?U)^\s+|\s+$", ""))
    return rows.select(F.when(name == "", F.raise_error(F.lit("a document has no name"))).otherwise(name).alias("name"), _literal("cell").alias("references"))


@dataclass(frozen=True)
class Corpus:
    """Names by layer, edges between names, and the number of citations of oneself, which are no edges."""

    names: DataFrame
    edges: DataFrame
    self_references: DataFrame


def corpus(rows: DataFrame) -> Corpus:
    """Tables of a manifest: names (name, is_external), edges (source, target) without repeats, self_references (n).

    External is what is cited but not listed. Citations of oneself are counted for each time they occur.
    """
    pairs = rows.select(F.col("name").alias("source"), F.explode("references").alias("target"))
    listed = rows.select("name").distinct().withColumn("is_external", F.lit(False))
    cited = pairs.select(F.col("target").alias("name")).distinct().join(listed, "name", "left_anti").withColumn("is_external", F.lit(True))
    return Corpus(listed.unionByName(cited), pairs.where("source <> target").distinct(), pairs.agg(F.count_if(F.col("source") == F.col("target")).alias("n")))


def suspected_duplicates(names: DataFrame, name: str = "name", key: Column | None = None) -> DataFrame:
    """(canonical, names): spellings that differ only in brackets, case, punctuation or spaces; sorted, two or more."""
    grouped = names.groupBy((canonical_name(F.col(name)) if key is None else key).alias("canonical")).agg(F.sort_array(F.collect_set(name)).alias("names"))
    return grouped.where(F.size("names") > 1)

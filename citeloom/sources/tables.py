"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core up to which a table of fewer files than cores is dealt out anew.
SMALL = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it stands in the folder.

    A small one in fewer files than there are cores, whose row groups may not be split, is dealt
    out to all cores, so that work on its rows is; anything larger is read in the scan's own splits.
    """
    path, cores = f"{folder}/{name}.parquet", spark.sparkContext.defaultParallelism
    df = spark.read.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("length").limit(cores).collect()
    if len(files) < cores and 1 << 16 < sum(f["length"] for f in files) < SMALL * cores:
        return df.repartition(cores)
    return df

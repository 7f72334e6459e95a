"""Helpers shared by the corpus operators: the shared folder, written intermediates, ranks, graph components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from itertools import accumulate
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of text handed to Python at once; texts can be long, so the default of 10,000 is too many.
TEXT_BATCH = 256
#: Largest number of rows that operators broadcast themselves; beyond it they shuffle.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; where it is unset, a temporary one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='citeloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lowers the number of rows in an Arrow batch, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


class Written:
    """A DataFrame written to the shared folder, so that lost executors cost no recomputation.

    Operators drop what their result does not read; the rest goes with drop_all(), at the latest
    when the driver's process ends.
    """

    alive: ClassVar[set[Written]] = set()

    def __init__(self, df: DataFrame, tag: str, codec: str = "snappy"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/citeloom/{tag}-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        Written.alive.add(self)

    def drop(self) -> None:
        Written.alive.discard(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_all() -> None:
    """Deletes all intermediates of this process; DataFrames that read them must have been used up."""
    for one in list(Written.alive):
        one.drop()


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        drop_all()


def written(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    return Written(df, tag, codec).df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame, *but: str) -> list[Column]:
    """All columns, whatever their names, except those named (in any case)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in but]


def text_of(text: str) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def global_rank(df: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Adds the 0-based position in the order of `key` (nulls last) without a single-task sort.

    Rows are dealt out by ranges of the key and written; a row's rank is its index inside its
    range plus the size of the ranges before it. Equal keys get neighbouring ranks.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).asc_nulls_last()
    dealt = df.repartitionByRange(n, F.col(key).isNull(), order).sortWithinPartitions(F.col(key).isNull(), order)
    dealt = written(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "rank")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # one row a range
    before = list(zip([r["__part"] for r in sizes], accumulate((r["n"] for r in sizes), initial=0)))
    before = spark.createDataFrame(before, "__part int, __before long")
    return dealt.join(F.broadcast(before), "__part").withColumn(rank, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def levels(scored: DataFrame, value: str, good: str) -> tuple[DataFrame, int, int]:
    """(value, last, lost, caught) for each distinct value, and the numbers of good and of bad rows; the column `good` is 1 or 0.

    lost and caught are the good and the bad rows below the value, last the value before it, null
    for the least. Values are counted, dealt out by ranges and summed within them; the sums of the
    ranges before, one row a range, are added. Every row counts, and no task holds all values.
    """
    spark = scored.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = scored.groupBy(F.col(value).cast("double").alias("value")).agg(F.sum(good).cast("long").alias("g"), F.sum(1 - F.col(good)).cast("long").alias("b"))
    cells = written(cells.repartitionByRange(n, "value").withColumn("part", F.spark_partition_id()), "cells")
    ranges = cells.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("value").alias("value")).orderBy("part").collect()  # one row a range
    before, good_rows, bad_rows, last = [], 0, 0, None
    for r in ranges:
        before.append((r["part"], good_rows, bad_rows, last))
        good_rows, bad_rows, last = good_rows + r["g"], bad_rows + r["b"], r["value"]
    before = spark.createDataFrame(before, "part int, g0 long, b0 long, last0 double")
    order = W.partitionBy("part").orderBy("value")
    below = order.rowsBetween(W.unboundedPreceding, -1)
    upto = lambda c: (F.col(f"{c}0") + F.coalesce(F.sum(c).over(below), F.lit(0)))
    cuts = cells.join(F.broadcast(before), "part").select("value", F.coalesce(F.lag("value").over(order), F.col("last0")).alias("last"), upto("g").alias("lost"), upto("b").alias("caught"))
    return cuts, good_rows, bad_rows


def _at_rest(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out > 0 AND into > 0").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an edge list (columns u and v, any order, repeats allowed).

    Alternates the large-star and small-star steps until only stars are left: each step
    is a grouped minimum and a join, so that no neighbourhood is gathered in one place, and the
    number of rounds grows with the logarithm of the size of a component. Every round's edges are
    written to the shared folder. Returns (node, label) for the nodes that have an edge.
    """
    u, v = F.col("u"), F.col("v")
    now = Written(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    rounds = 0
    while not _at_rest(now.df):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        rounds += 1
        both = now.df.unionByName(now.df.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(best, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).unionByName(best.select("u", F.col("m").alias("v"))).distinct()
        new = Written(small, "edges")
        now.drop()
        now = new
    # at rest every node points at its component's least node
    return now.df.select(u.alias("node"), v.alias("label")).unionByName(now.df.select(v.alias("node"), v.alias("label")).distinct())

"""Continuous ingest: keyed inserts over micro-batches, and counts in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import new_folder


def read(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def first_seen(events: DataFrame, key: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row of each key: what an insert-if-absent keeps; state is bounded by the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def counted(events: DataFrame, by: list[str], time: str = "ts", width: str = "1 hour", late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Count and sum in tumbling windows; a window closes when the watermark passes its end."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def drained(result: DataFrame) -> DataFrame:
    """What a result in complete mode holds once all that is there has been read.

    Each micro-batch is written by executors under spark.checkpoint.dir; the last one's folder is read back.
    """
    spark = result.sparkSession
    folder = new_folder(spark, "stream")
    last = [-1]

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        last[0] = number

    result.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/{last[0]}") if last[0] >= 0 else spark.createDataFrame([], result.schema)

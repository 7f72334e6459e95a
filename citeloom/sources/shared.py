"""Intermediates in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_HELD = threading.local()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below spark.checkpoint.dir, deleted when the driver's process ends, or before, see dropped(); a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='citeloom-')}"
    folder = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if (held := getattr(_HELD, "folders", None)) is not None:
        held.append((spark, folder))
    else:
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def dropped() -> Iterator[None]:
    """Folders that this thread makes meanwhile go at the end: for work that ends in a commit, so that a long-lived driver does not fill the disk."""
    outer, _HELD.folders = getattr(_HELD, "folders", None), []
    try:
        yield
    finally:
        for spark, folder in _HELD.folders:
            _delete(spark, folder)
        _HELD.folders = outer


def written(df: DataFrame, kind: str) -> DataFrame:
    """df computed once and read back from the shared folder: what several branches read is not computed in each."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

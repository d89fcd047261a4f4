"""Broadcast decisions: a side is broadcast only after its rows are counted to be few."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows that one broadcast may hold (about 30 MB of positions).
ROWS = 1_000_000


def index_folder(spark: SparkSession) -> str:
    """A new folder for an index in the folder that all executors share; on one machine without one, a local folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/gramlode-index-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(hadoop)
    store.deleteOnExit(hadoop)
    return path


def checked(df: DataFrame, rows: int = ROWS) -> tuple[DataFrame, bool]:
    """df marked for broadcast if it has so many rows at most, and whether it has; else df as it is.

    Counting stops one row beyond the bound.
    """
    few = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if few else df), few

"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only on one machine, where the session names none, a local one is made."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        own = made.get() if made.isDefined() else None
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="gramlode-")
        spark.sparkContext.setCheckpointDir(own)
    return own


_FOLDERS: dict[str, str] = {}


def own_folder(spark: SparkSession) -> str:
    """The application's folder for intermediate tables in the shared one, removed when the driver's JVM ends."""
    key = spark.sparkContext.applicationId
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{shared_dir(spark).rstrip('/')}/gramlode-{key}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[key])
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return _FOLDERS[key]


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{own_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Lineage cut through a reliable checkpoint; for narrow tables."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def stored(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Lineage cut through a Parquet table in the shared folder; for wider tables."""
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is run at once hands Python so many rows in a batch at most; for rows of long lists or texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Gives memory that a worker's task has freed back to the system, as workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function over batches, whose memory goes back to the system once its task has ended and holds nothing."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        release()

    return whole


def emptied(spark: SparkSession) -> None:
    """The executors' JVMs give back to the system what jobs have left in them. Their collectors let a heap grow to its bound
    before they collect it all, and do not count what stands beside it: buffers, which garbage keeps, and Python workers.

    A task for each core, as tasks go round the executors; requests that an executor gets at once are one collection.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


#: Models that a worker loads once and keeps, by the module that loads them.
_MODELS: dict[str, list] = {}


def kept_model(maxsize: int) -> Callable:
    """lru_cache for a model that tasks of other operators in the same worker may drop."""

    def wrap(load: Callable) -> Callable:
        _MODELS.setdefault(load.__module__, []).append(cached := lru_cache(maxsize=maxsize)(load))
        return cached

    return wrap


def alone(module: str) -> None:
    """Drops the models that other modules' tasks have left in this worker."""
    for owner, caches in _MODELS.items():
        if owner != module and any(c.cache_info().currsize for c in caches):
            for c in caches:
                c.cache_clear()
            gc.collect()
            release()


def words(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    bare = F.regexp_replace(text, rf"^[{SPACE}]+", "")
    bare = F.rtrim(bare, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"[{SPACE}]+"))


#: A table of group parameters is broadcast up to so many rows; beyond that it is joined by a shuffle.
BROADCAST_ROWS = 20_000


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table that is cut already, marked for broadcast only if it is counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key from which on they are joined where they are instead of being sent to one task.
HOT_ROWS = 200_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """left joined to right, which has one row for each key and in the column rows how many of left have it; without rows.

    right is cut already. Keys with many rows are broadcast (at most one for each HOT_ROWS rows of left), so none of
    their rows is shuffled; the others are joined by a shuffle.
    """
    hot = right.where(F.col(rows) > HOT_ROWS).drop(rows)
    if hot.isEmpty():
        return left.join(right.drop(rows), key)
    few = checked(hot)
    rest = left.join(checked(hot.select(key)), key, "left_anti").join(right.where(F.col(rows) <= HOT_ROWS).drop(rows), key)
    return left.join(few, key).unionByName(rest)

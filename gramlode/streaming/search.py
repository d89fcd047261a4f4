"""Streams of queries against a static index.

A query arrives whole in one row, so no state crosses micro-batches: each batch is one search plan against the index,
whose bits are read with the batch's positions broadcast when they are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmers import FilterSpec
from ..operators.search import search

QUERY_SCHEMA = "batch_ix int, name string, seq string, threshold double"


def query_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Queries from JSON files that are put into a folder."""
    return spark.readStream.schema(QUERY_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def search_stream(queries: DataFrame, filters: DataFrame, bits: DataFrame, spec: FilterSpec, sink: Callable[[DataFrame, int], None], checkpoint: str, distinct: bool = False, adjust: bool = False, interval: str | None = None) -> StreamingQuery:
    """Starts a stream whose sink gets the matches of each micro-batch and its number, again after a failure.

    interval, such as "10 seconds": the stream runs on and looks for new queries that often; without it, it ends when
    all queries that are there have been answered.
    """

    def one(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            sink(search(held, filters, bits, spec, distinct, adjust), number)
        finally:
            held.unpersist()

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def to_parquet(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch overwrites."""
    return lambda matches, number: matches.write.mode("overwrite").parquet(f"{folder}/batch={number}")

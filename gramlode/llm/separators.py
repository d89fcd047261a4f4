"""Token counts by separator scan of flat token files that have no index.

A flat file is the ids of many documents as little-endian unsigned 16-bit integers, an end-of-document id after each.
Files are cut into blocks of equal size without regard to documents; tasks search their blocks for separators in one
vectorised comparison and report absolute places. A document that spans blocks is stitched by a prefix scan over the
blocks of a file: the running count of separators numbers the documents, the running maximum of places gives the
separator before the first one of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, stored, table
from .files import made, opened, own_name, part_number, read_range
from .secrets import encoding

VOCABULARY, END_ID = "byte_bpe_50k.tiktoken", 50256
#: Ids of a block.
BLOCK = 1 << 21


def write_flat(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """docs: doc_id, text. Every task writes the documents it scans to one flat file, so no text is shuffled.

    Returns part, path, ordinal, doc_id: the order in which documents were written, which the files do not hold.
    A null or empty text is a separator alone.
    """
    made(folder)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name, n = encoding(vocabulary), own_name(folder, "flat"), 0
        store, path = opened(name)
        with store.open_output_stream(path) as f:
            for b in batches:
                for t in b.column(1):
                    f.write(np.array(enc.encode_ordinary(t.as_py()), "<u2").tobytes() + end)
                k = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([part_number()] * k, pa.int32()), pa.array([name] * k), pa.array(range(n, n + k), pa.int64()), b.column(0)], names=["part", "path", "ordinal", "doc_id"])
                n += k

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(spark, rows.mapInArrow(run, "part int, path string, ordinal long, doc_id long"), "flat-order")


def count(spark: SparkSession, paths: DataFrame, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """paths: path (distinct). path, ordinal, n_tokens, closed for each document of the flat files.

    n_tokens leaves the separator out. Ids behind a file's last separator are a last document with closed false.
    A file without ids has no documents.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                store, path = opened(p)
                n = store.get_file_info(path).size // 2
                k = -(-n // block)
                yield pa.RecordBatch.from_arrays([pa.array([p] * k, pa.string()), pa.array(range(k), pa.int64()), pa.array([n] * k, pa.int64())], names=["path", "block", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, k, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(read_range(p, 2 * block * k, 2 * block), "<u2")
                ends = np.flatnonzero(ids == end_id) + block * k
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([k]), pa.array([n]), pa.array([ends], pa.list_(pa.int64()))], names=["path", "block", "ids", "ends"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = paths.select("path").repartition(parts, "path").mapInArrow(blocks, "path string, block long, ids long")
    found = cut.repartition(parts, "path", "block").mapInArrow(scan, "path string, block long, ids long, ends array<long>")
    w = W.partitionBy("path").orderBy("block")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumns({
        "_base": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        "_last": F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)),
        "_final": F.lead("block").over(w).isNull(),
    })
    lengths = F.transform("ends", lambda e, i: F.struct((F.col("_base") + i).alias("ordinal"), (e - F.when(i == 0, F.col("_last")).otherwise(F.get("ends", i - 1)) - 1).alias("n_tokens"), F.lit(True).alias("closed")))
    last = F.greatest(F.col("_last"), F.coalesce(F.array_max("ends"), F.lit(-1)))
    open_end = F.struct((F.col("_base") + F.size("ends")).alias("ordinal"), (F.col("ids") - 1 - last).alias("n_tokens"), F.lit(False).alias("closed"))
    rest = F.when(F.col("_final") & (last < F.col("ids") - 1), F.array(open_end)).otherwise(F.filter(F.array(open_end), lambda x: F.lit(False)))
    return found.select("path", F.explode(F.concat(lengths, rest)).alias("d")).select("path", "d.ordinal", "d.n_tokens", "d.closed")


def token_counts(spark: SparkSession, docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id and n_tokens for each row of docs (doc_id, text; columns of other names, whatever they are, are ignored),
    counted in flat files that hold their ids. A null or empty text has none. Repeated rows each count, texts of any
    length are encoded whole, and an empty table gives none."""
    order = write_flat(spark, docs, folder or fresh_path(spark, "flat"))
    counts = count(spark, order.select("path").distinct())
    # either side grows with the documents, so neither is broadcast
    return order.join(counts.hint("merge"), ["path", "ordinal"]).select("doc_id", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"))

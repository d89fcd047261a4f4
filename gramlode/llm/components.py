"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node, combined before the shuffle, and one equi-join; no neighbourhood is ever gathered.
Callers may let a task follow an edge table of bounded length by itself; a longer one goes by the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v (bigint) of all edges: node, root."""
    own = [np.stack([np.asarray(c, np.int64) for c in b.columns], axis=1) for b in batches]
    if not own:
        return
    node, e = np.unique(np.concatenate(own), return_inverse=True)
    u, v = e.reshape(-1, 2).T
    low = np.arange(len(node))
    while True:
        x, y = low[u], low[v]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))  # roots alone are lowered: x and y are roots
        while not ((up := low[low]) == low).all():
            low = up
    for k in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(node[k : k + (1 << 16)]), pa.array(node[low[k : k + (1 << 16)]])], names=["node", "root"])


def components(spark: SparkSession, edges: DataFrame, alone: int = 0) -> DataFrame:
    """edges: u, v (comparable, u != v). Returns node, root: the smallest node that each node with an edge can reach.

    Rounds go on until nothing changes; every round shortens all paths, so their number grows with the logarithm of the
    longest one. No edges give no rows. Up to alone edges (of bigint) are followed in one task, without rounds.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, before = cut(spark, e), None
    if alone and e.limit(alone + 1).count() <= alone:
        return cut(spark, e.repartition(1).mapInArrow(_reached, "node bigint, root bigint"))
    while (now := tuple(e.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != before:
        before = now
        e = cut(spark, _small_star(_large_star(e)))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

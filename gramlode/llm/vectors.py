"""Exact top-k by inner product through a vector-approximation file.

The approximation file is written once: for every vector the cell of each component, a byte on a grid of 256 cells over
that component's range, packed in chunks of vectors. Blocks of queries meet the chunks in one scan: since cells have
equal widths, one product of cells and scaled query gives a base score, and the true score lies between the base and the
base plus a gap that depends on the query alone. What beats the k-th best base less the gap is a candidate. Exact vectors
are then read in the order of their bounds: first the best few of each query, and further ones only while their upper
bound reaches the k-th exact score, so the result is certain.

Queries stay distributed: blocks are rows of a table, dealt to the parts of the file by an equi-join. Components too
large for exact arithmetic in doubles leave the file; such vectors are candidates of every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

#: Best rows, cells of a component, queries of a block, vectors of a chunk, which ids ask, and the scale of components.
K, CELLS, BLOCK, CHUNK, EVERY, SCALE = 5, 256, 1024, 4096, 50, 256
#: Candidates of a query that are read first, as a multiple of k; blocks of queries that are broadcast.
FIRST, FEW_BLOCKS = 4, 8
#: Components from LARGE on are not approximated; scores end at the limits of a bigint.
LARGE, TOP = 1 << 21, (1 << 63) - 1


def usable(v: Column) -> Column:
    """True where a vector is there and all its components are finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(v: Column, scale: int = SCALE) -> Column:
    return F.transform(v, lambda x: F.floor(scale * x.cast("double")))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of dim columns; shorter vectors end in zeros."""
    sizes = np.diff(np.asarray(lists.offsets, np.int64))
    flat = np.asarray(lists.values, np.int64)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _small(m: np.ndarray) -> np.ndarray:
    return ((m > -LARGE) & (m < LARGE)).all(1)


def _ranges(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least value and width of a cell for each component; one row of each task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            if b.num_rows:
                sizes = np.diff(np.asarray(b.column(0).offsets, np.int64))
                m = _matrix(b.column(0), max(len(low), int(sizes.max())))
                grown = m.shape[1] - len(low)
                low, high = (np.append(x, np.zeros(grown, np.int64)) for x in (low, high))  # zeros: what short vectors end in
                m = m[_small(m)]
                if len(m):
                    low, high = np.minimum(low, m.min(0)), np.maximum(high, m.max(0))
        yield pa.RecordBatch.from_arrays([pa.array([low], pa.list_(pa.int64())), pa.array([high], pa.list_(pa.int64()))], names=["low", "high"])

    got = vectors.select("v").mapInArrow(run, "low array<long>, high array<long>").collect()
    dim = max([1, *(len(r.low) for r in got)])
    low, high = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    for r in got:
        low[: len(r.low)], high[: len(r.low)] = np.minimum(low[: len(r.low)], r.low), np.maximum(high[: len(r.low)], r.high)
    return low, -(-(high - low + 1) // CELLS)


def approximations(spark: SparkSession, vectors: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """The file, written and read back. vectors: vec_id, v. For each chunk: ids, cells (both packed), and exact: the ids
    of vectors that are not approximated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, CHUNK):
                part = b.slice(k, CHUNK)
                ids, m = np.asarray(part.column(0), np.int64), _matrix(part.column(1), len(low))
                small = _small(m)
                cells = ((m[small] - low) // width).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids[small].astype("<i8"), cells, ids[~small].astype("<i8"))], names=["ids", "cells", "exact"])

    return stored(spark, vectors.select("vec_id", "v").mapInArrow(run, "ids binary, cells binary, exact binary"), "vector-cells")


def query_blocks(spark: SparkSession, asked: DataFrame, dim: int, block: int = BLOCK) -> DataFrame:
    """asked: vec_id, v. queries: packed ids, vectors: packed components, for each block of so many queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, block):
                part = b.slice(k, block)
                ids, m = np.asarray(part.column(0), "<i8"), _matrix(part.column(1), dim).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, m)], names=["queries", "vectors"])

    return stored(spark, asked.select("vec_id", "v").mapInArrow(run, "queries binary, vectors binary"), "vector-queries")


def _scan(low: np.ndarray, width: np.ndarray, k: int):
    """Pairs of a chunk and a block: the candidates of each query. A worker remembers the k-th best bases of the blocks
    it has seen last, so that later chunks give less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kth: dict[bytes, np.ndarray] = {}
        for b in batches:
            for ids, cells, exact, asked, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, exact, qs = (np.frombuffer(x, "<i8") for x in (ids, exact, asked))
                m = np.frombuffer(cells, np.uint8).reshape(-1, len(low)).astype(float)
                q = np.frombuffer(packed, "<i8").reshape(-1, len(low))
                plain = _small(q)
                qf = np.where(plain[:, None], q, 0).astype(float)
                gap = np.abs(qf) @ ((width - 1) + 2.0**-46 * (CELLS * width + np.abs(low)))  # and what rounding may do
                base = (qf * width) @ m.T + (qf @ low.astype(float) + np.minimum(qf, 0) @ (width - 1).astype(float))[:, None]
                base[ids[None, :] == qs[:, None]] = -np.inf  # a query's own rows take no part
                best = kth.pop(asked, np.full((len(qs), k), -np.inf))
                some = np.partition(base, base.shape[1] - k, axis=1)[:, -k:] if base.shape[1] > k else base
                best = np.sort(np.concatenate([best, some], axis=1), axis=1)[:, -k:]
                kth[asked] = best
                if len(kth) > 256:
                    kth.pop(next(iter(kth)))
                i, j = np.nonzero((base >= (best[:, 0] - gap)[:, None]) & (base > -np.inf) | (~plain[:, None] & (ids[None, :] != qs[:, None])))
                at, to = np.nonzero(exact[None, :] != qs[:, None])
                sure = np.concatenate([plain[i], np.zeros(len(at), bool)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([qs[i], qs[at]])), pa.array(np.concatenate([ids[j], exact[to]])),
                    pa.array(np.where(sure, np.concatenate([base[i, j], np.zeros(len(at))]), np.inf)), pa.array(np.concatenate([gap[i], np.zeros(len(at))])), pa.array(sure),
                ], names=["query_id", "vec_id", "base", "gap", "sure"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, v, q: the inner products, with integers of any size where a double or long might not do."""
    for b in batches:
        if not b.num_rows:
            continue
        dim = max(1, *(int(np.diff(np.asarray(c.offsets)).max()) for c in b.columns[2:]))
        m, q = _matrix(b.column(2), dim), _matrix(b.column(3), dim)
        plain = _small(m) & _small(q)
        s = np.einsum("ij,ij->i", np.where(plain[:, None], m, 0), np.where(plain[:, None], q, 0))
        for i in np.flatnonzero(~plain):
            s[i] = max(-TOP - 1, min(TOP, sum(x * y for x, y in zip(m[i].tolist(), q[i].tolist(), strict=True))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["query_id", "vec_id", "score"])


def top_k(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """vectors: vec_id, embedding (others are ignored). query_id, rank, vec_id, score for each vec_id divisible by every.

    Vectors that are null or hold a null or non-finite component, and null vec_ids, take no part. A query meets every
    row but those of its own vec_id; ties go to the smaller vec_id. Repeated query rows count once (of different vectors
    of one vec_id the least asks), repeated candidate rows each. Vectors of different lengths are filled with zeros. An
    empty table gives no rows.
    """
    base = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"))
    asked = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    low, width = _ranges(base)
    cells = approximations(spark, base, low, width)
    blocks = query_blocks(spark, asked, len(low), block)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    few = blocks.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS
    pairs = cells.withColumn("part", F.pmod(F.xxhash64("ids", "exact"), F.lit(parts)).cast("int")).join(F.broadcast(dealt) if few and parts <= 64 else dealt.hint("merge"), "part")
    kind = "query_id long, vec_id long, base double, gap double, sure boolean"
    found = stored(spark, pairs.select("ids", "cells", "exact", "queries", "vectors").mapInArrow(_scan(low, width, k), kind), "vector-candidates")
    kth = found.where("sure").withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("base").desc()))).where(F.col("_r") == k)
    kth = kth.select("query_id", F.col("base").alias("_least"))
    near = found.join(kth, "query_id", "left").where("_least is null or not sure or base + gap >= _least")
    near = near.groupBy("query_id", "vec_id").agg(F.max(F.col("base") + F.col("gap")).alias("upper"))
    near = stored(spark, near.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("upper").desc(), "vec_id"))), "vector-near")

    def exact(some: DataFrame) -> DataFrame:
        pairs = some.select("query_id", "vec_id").join(base, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        return pairs.select("query_id", "vec_id", "v", "q").mapInArrow(_exact, "query_id long, vec_id long, score long")

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first = stored(spark, exact(near.where(F.col("_r") <= FIRST * k)), "vector-first")
    reached = first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col("score").alias("_kth"))
    rest = near.where(F.col("_r") > FIRST * k).join(reached, "query_id", "left").where("_kth is null or upper >= _kth")
    every_score = first.unionByName(exact(rest))
    return every_score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"))


SQL = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""

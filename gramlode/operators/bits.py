"""Algebra of bit vectors stored as rows of set positions (vec, pos).

Operations are combined by grouping on position, so any number of vectors takes one shuffle, combined before it.
Ranks and squeezes number rows by position: positions are first ranged into chunks, counted per chunk, and offset by
the running count of earlier chunks, so no window ever holds a whole vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a chunk in which rows are numbered.
CHUNK = 1 << 16


def _count(vectors: DataFrame, ids: list[str]) -> DataFrame:
    return vectors.where(F.col("vec").isin(ids)).groupBy("pos").agg(F.count("*").alias("c"))


def intersection(vectors: DataFrame, ids: list[str]) -> DataFrame:
    return _count(vectors, ids).where(F.col("c") == len(ids)).select("pos")


def union(vectors: DataFrame, ids: list[str]) -> DataFrame:
    return vectors.where(F.col("vec").isin(ids)).select("pos").distinct()


def parity(vectors: DataFrame, ids: list[str]) -> DataFrame:
    """Exclusive or of any number of vectors."""
    return _count(vectors, ids).where(F.col("c") % 2 == 1).select("pos")


def _flags(vectors: DataFrame, a: str, b: str) -> DataFrame:
    in_ = lambda v: F.max((F.col("vec") == v).cast("int"))
    return vectors.where(F.col("vec").isin([a, b])).groupBy("pos").agg(in_(a).alias("a"), in_(b).alias("b"))


def mask(vectors: DataFrame, a: str, b: str) -> DataFrame:
    """Bits of a that b has not."""
    return _flags(vectors, a, b).where("a = 1 and b = 0").select("pos")


def complement(spark: SparkSession, ones: DataFrame, num_bits: int) -> DataFrame:
    return spark.range(num_bits).withColumnRenamed("id", "pos").join(ones.select("pos"), "pos", "left_anti")


def equal(spark: SparkSession, vectors: DataFrame, a: str, b: str, num_bits: int) -> DataFrame:
    """Bits in which a and b agree."""
    return complement(spark, parity(vectors, [a, b]), num_bits)


def or_not(spark: SparkSession, vectors: DataFrame, a: str, b: str, num_bits: int) -> DataFrame:
    """Bits that a has or b has not."""
    return complement(spark, mask(vectors, b, a), num_bits)


def check_lengths(lengths: dict[str, int]) -> int:
    """The common length of operands; different ones are an error."""
    if len(set(lengths.values())) != 1:
        raise ValueError(f"operands differ in length: {lengths}")
    return next(iter(lengths.values()))


def ordinals(ones: DataFrame, keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """ones with ord: how many set bits of the same keys lie below (0 for the first)."""
    keys = keys or []
    at = ones.withColumn("_chunk", F.expr(f"div(pos, {chunk}L)"))
    sizes = at.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy("pos")) - 1
    return at.withColumn("_in", inner).join(base, [*keys, "_chunk"]).withColumn("ord", (F.col("_base") + F.col("_in")).cast("long")).drop("_chunk", "_in", "_base")


def rank1(ones: DataFrame, asked: DataFrame, num_bits: int, chunk: int = CHUNK) -> DataFrame:
    """asked: n (0 to num_bits). n, rank1 (ones in the first n positions), rank0."""
    at = ones.select("pos").withColumn("_chunk", F.expr(f"div(pos, {chunk}L)"))
    sizes = at.groupBy("_chunk").agg(F.count("*").alias("_n"))
    q = asked.select("n").distinct().withColumn("_chunk", F.expr(f"div(n, {chunk}L)"))
    chunks = sizes.select("_chunk", "_n").unionByName(q.select("_chunk").distinct().withColumn("_n", F.lit(0).cast("long"))).groupBy("_chunk").agg(F.sum("_n").alias("_n"))
    base = chunks.select("_chunk", F.coalesce(F.sum("_n").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    both = at.select("_chunk", F.col("pos").alias("x"), F.lit(1).alias("bit")).unionByName(q.select("_chunk", F.col("n").alias("x"), F.lit(0).alias("bit")))
    below = F.sum("bit").over(W.partitionBy("_chunk").orderBy("x", "bit").rowsBetween(W.unboundedPreceding, 0))
    r = both.withColumn("_in", below).where("bit = 0").join(base, "_chunk").select(F.col("x").alias("n"), (F.col("_base") + F.col("_in")).cast("long").alias("rank1"))
    return r.select("n", "rank1", (F.col("n") - F.col("rank1")).alias("rank0"))


def select1(ones: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, r, pos: place of the r-th set bit, from 0."""
    return ordinals(ones, keys).select(*(keys or []), F.col("ord").alias("r"), "pos")


def select0(spark: SparkSession, ones: DataFrame, num_bits: int) -> DataFrame:
    """r, pos: place of the r-th clear bit, from 0."""
    return select1(complement(spark, ones, num_bits))


def squeeze(ones: DataFrame, spec: DataFrame) -> DataFrame:
    """Bits of a vector at the set places of another, packed: pos is the rank of the place."""
    return ordinals(spec.select("pos")).join(ones.select("pos"), "pos", "left_semi").select(F.col("ord").alias("pos"))


def unsqueeze(ones: DataFrame, spec: DataFrame) -> DataFrame:
    """The inverse: bit i of the vector goes to the i-th set place of the other."""
    o = ordinals(spec.select("pos")).select(F.col("pos").alias("to"), F.col("ord").alias("pos"))
    return o.join(ones.select("pos"), "pos", "left_semi").select(F.col("to").alias("pos"))


def simplify(vectors: DataFrame, ids: DataFrame, num_bits: int) -> DataFrame:
    """vec, kind: zeros, ones or mixed."""
    c = ids.select("vec").distinct().join(vectors.groupBy("vec").agg(F.count_distinct("pos").alias("c")), "vec", "left")
    return c.select("vec", F.when(F.coalesce("c", F.lit(0)) == 0, "zeros").when(F.col("c") == num_bits, "ones").otherwise("mixed").alias("kind"))


def density(vectors: DataFrame, num_bits: int, start: int = 0, end: int | None = None) -> DataFrame:
    """vec, ones, density within an interval of positions."""
    end = num_bits if end is None else end
    v = vectors.where((F.col("pos") >= start) & (F.col("pos") < end))
    return v.groupBy("vec").agg(F.count("*").alias("ones"), (F.count("*") / (end - start)).alias("density"))


def counts(vectors: DataFrame, a: str, b: str, num_bits: int) -> DataFrame:
    """One row: ones of both, and of their and, or, exclusive or, mask and or-not."""
    f = _flags(vectors, a, b)
    n = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return f.agg(n("a").alias("ones_a"), n("b").alias("ones_b"), n("a * b").alias("n_and"), F.count("*").alias("n_or"), n("a ^ b").alias("n_xor"), n("a * (1 - b)").alias("n_mask"), (F.lit(num_bits) - n("b * (1 - a)")).alias("n_or_not"))


def to_buckets(vectors: DataFrame) -> DataFrame:
    """vec, bucket, bitmap: packed bitmaps of 32,768 bits; positions are shifted by one so that all buckets are even."""
    p = F.col("pos") + 1
    return vectors.groupBy("vec", F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bitmap"))


def union_buckets(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bucket_ones(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("ones"))


def as_text(ones: DataFrame, num_bits: int) -> str:
    """The vector as a string of 0 and 1; for small vectors, such as a dump of the first bits."""
    on = {r.pos for r in ones.where(F.col("pos") < num_bits).collect()}
    return "".join("1" if i in on else "0" for i in range(num_bits))

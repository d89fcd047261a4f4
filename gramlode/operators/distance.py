"""Distances between bit vectors: one join on words of 64 positions counts common bits, totals give the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("hamming", "intersection", "union", "jaccard", "theta")


def common_bits(vectors: DataFrame, focus: DataFrame | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """u, v, ones_u, ones_v, common for all pairs u < v, or for each focus vector against all.

    Pairs without a common bit are included, so the result has a row for each pair asked for.
    """
    v = vectors.where(F.col("pos") >= start)
    v = v.where(F.col("pos") < end) if end is not None else v
    v = v.select("vec", "pos")
    ids = vectors.select("vec").distinct()
    ones = ids.join(v.groupBy("vec").agg(F.count("*").alias("ones")), "vec", "left").fillna(0, ["ones"])
    words = v.groupBy("vec", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)).cast("int"))).alias("x"))
    a, b = words.select(F.col("vec").alias("u"), "word", F.col("x").alias("x")), words.select(F.col("vec").alias("v"), "word", F.col("x").alias("y"))
    left, right = ones.select(F.col("vec").alias("u"), F.col("ones").alias("ones_u")), ones.select(F.col("vec").alias("v"), F.col("ones").alias("ones_v"))
    if focus is not None:
        f = focus.select(F.col("vec").alias("u")).distinct()
        a, left = a.join(f, "u", "left_semi"), left.join(f, "u", "left_semi")
        on = F.lit(True)
    else:
        on = F.col("u") < F.col("v")
    shared = a.join(b, "word").where(on).groupBy("u", "v").agg(F.sum(F.bit_count(F.col("x").bitwiseAND(F.col("y")))).alias("common"))
    return left.join(right, on).join(shared, ["u", "v"], "left").select("u", "v", "ones_u", "ones_v", F.coalesce("common", F.lit(0)).alias("common"))


def distances(vectors: DataFrame, metric: str = "hamming", focus: DataFrame | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """u, v and the metric; jaccard and theta come with their numerator and denominator, null where that is 0.

    theta is one-sided and has a row for both directions of a pair.
    """
    if metric not in METRICS:
        raise ValueError(f"{metric} is none of {', '.join(METRICS)}")
    c = common_bits(vectors, focus, start, end)
    both = F.col("ones_u") + F.col("ones_v") - F.col("common")
    if metric == "hamming":
        return c.select("u", "v", (both - F.col("common")).alias("hamming"))
    if metric == "intersection":
        return c.select("u", "v", F.col("common").alias("intersection"))
    if metric == "union":
        return c.select("u", "v", both.alias("union"))
    if metric == "jaccard":
        return c.select("u", "v", F.col("common").alias("numerator"), both.alias("denominator"), F.try_divide(F.col("common"), both).alias("jaccard"))
    if focus is None:
        c = c.unionByName(c.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("ones_v").alias("ones_u"), F.col("ones_u").alias("ones_v"), "common"))
    return c.select("u", "v", F.col("common").alias("numerator"), F.col("ones_u").alias("denominator"), F.try_divide(F.col("common"), F.col("ones_u")).alias("theta"))

"""Building Bloom filters as tables of set positions, and asking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rates import false_positive_rate
from ..functions.hashing import PACKED
from .kmers import FilterSpec, canonical_text, count_kmers, kmers, packed_counts, packed_positions, positions


def describe(ids: DataFrame, spec: FilterSpec, kind: str = "simple") -> DataFrame:
    """filters table of ids: filter_id, set_size."""
    lit = lambda v, t: F.lit(v).cast(t)
    return ids.select(
        "filter_id", F.lit(kind).alias("kind"), lit(spec.k, "int").alias("k"), lit(spec.num_hashes, "int").alias("num_hashes"), lit(spec.seed1, "long").alias("seed1"),
        lit(spec.seed2, "long").alias("seed2"), lit(spec.range, "long").alias("modulus"), lit(spec.num_bits, "long").alias("num_bits"), F.col("set_size").cast("long").alias("set_size"),
    )


def build(sequences: DataFrame, spec: FilterSpec, least: int = 1, filter_id: str = "filter_id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """filters and filter_bits of the sequences of each filter_id.

    With an abundance of 1, positions are hashed straight from sequences and only distinct ones are shuffled; the set
    size, which needs the k-mers themselves, is a separate column that costs nothing unless it is read. With a higher
    abundance k-mers are counted first. K-mers of up to 31 letters are counted packed, two bits a letter.
    """
    s = sequences.select(F.col(filter_id).alias("filter_id"), F.col(seq).alias("seq"))
    short = spec.k <= PACKED
    counted = packed_counts(s, spec.k, "filter_id", "seq", spec.canonical, least) if short else count_kmers(kmers(s, spec.k), ["filter_id"], spec.canonical, least)
    sizes = s.select("filter_id").distinct().join(counted.groupBy("filter_id").agg(F.count("*").alias("set_size")), "filter_id", "left").fillna(0, ["set_size"])
    if least <= 1:
        bits = positions(s, spec, distinct_in_row=True).distinct()
    else:
        bits = (packed_positions(counted, spec, "filter_id") if short else positions(counted.select("filter_id", F.col("mer").alias("seq")), spec)).distinct()
    return describe(sizes, spec), bits.select("filter_id", F.lit(0).alias("vector_ix"), "pos")


def build_from_kmers(mers: DataFrame, spec: FilterSpec) -> tuple[DataFrame, DataFrame]:
    """mers: filter_id, mer. Repeated k-mers count again in the set size, as in a list of k-mers."""
    sizes = mers.groupBy("filter_id").agg(F.count("*").alias("set_size"))
    bits = positions(mers.select("filter_id", F.col("mer").alias("seq")), spec).distinct()
    return describe(sizes, spec), bits.select("filter_id", F.lit(0).alias("vector_ix"), "pos")


def constant(spark: SparkSession, filter_id: str, spec: FilterSpec, ones: bool) -> tuple[DataFrame, DataFrame]:
    """A filter of zeros or of ones."""
    row = spark.createDataFrame([(filter_id, 0)], "filter_id string, set_size long")
    bits = spark.range(spec.num_bits if ones else 0).select(F.lit(filter_id).alias("filter_id"), F.lit(0).alias("vector_ix"), F.col("id").alias("pos"))
    return describe(row, spec), bits


def spec_of(filters: DataFrame, filter_id: str) -> FilterSpec:
    """Parameters of an existing filter, for building another like it."""
    r = filters.where(F.col("filter_id") == filter_id).first()
    if r is None:
        raise ValueError(f"no filter {filter_id}")
    return FilterSpec(r.k, r.num_bits, r.modulus, r.num_hashes, r.seed1, r.seed2)


def build_vectors(sequences: DataFrame, k: int, num_bits: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Bare bit vectors (no modulus) and their counts of ones: (filter_bits, filter_id with ones_count)."""
    _, bits = build(sequences, FilterSpec(k, num_bits), least)
    return bits, bits.groupBy("filter_id").agg(F.count("*").alias("ones_count"))


def random_vector(spark: SparkSession, num_bits: int, density: float = 0.10, seed: int = 0, ones: int | None = None) -> DataFrame:
    """pos: each bit set with a chance of density, or exactly so many ones."""
    r = spark.range(num_bits).withColumnRenamed("id", "pos")
    if ones is None:
        return r.where(F.rand(seed) < density)
    return r.orderBy(F.rand(seed), "pos").limit(ones)


def stats(filters: DataFrame) -> DataFrame:
    """filename, num_hashes, num_bits (the modulus), kmers_added, bf_fp_rate by the modulus."""
    rate = None
    one, many = false_positive_rate(1, F.col("modulus"), F.col("set_size")), F.pow(1.0 - F.exp(-(F.col("num_hashes") * F.col("set_size")) / F.col("modulus").cast("double")), F.col("num_hashes"))
    rate = F.when(F.col("num_hashes") == 1, one).otherwise(many)
    return filters.select(F.concat("filter_id", F.lit(".bf")).alias("filename"), "num_hashes", F.col("modulus").alias("num_bits"), F.col("set_size").alias("kmers_added"), rate.alias("bf_fp_rate"))


PROPERTIES = ("kind", "k", "num_hashes", "seed1", "seed2", "modulus", "num_bits")


def inconsistent(filters: DataFrame) -> list[str]:
    """Names of the properties in which the filters differ."""
    r = filters.agg(*[F.count_distinct(c).alias(c) for c in PROPERTIES]).first()
    return [c for c in PROPERTIES if r[c] > 1]


def check_consistent(filters: DataFrame) -> None:
    if bad := inconsistent(filters):
        raise ValueError(f"filters differ in {', '.join(bad)}")


def contained(mers: DataFrame, filters: DataFrame, bits: DataFrame, spec: FilterSpec) -> DataFrame:
    """mers: mer. filter_id, mer of the k-mers that a filter contains: it has as many of their positions as they need.

    Only k-mers whose positions all lie outside the filter, which every filter contains, are paired with the filters.
    """
    m = mers.select("mer").distinct()
    p = positions(m.select("mer", F.col("mer").alias("seq")), spec).distinct()
    need = p.groupBy("mer").agg(F.count("*").alias("need"))
    got = p.join(bits.select("filter_id", "pos"), "pos").groupBy("filter_id", "mer").agg(F.count("*").alias("got"))
    free = filters.select("filter_id").join(m.join(need, "mer", "left_anti"))
    return got.join(need, "mer").where("got = need").select("filter_id", "mer").unionByName(free)


def contains(mers: DataFrame, filters: DataFrame, bits: DataFrame, spec: FilterSpec) -> DataFrame:
    """mers: mer. filter_id, mer, present: all positions of the k-mer that lie in the filter are set.

    A k-mer whose positions all lie outside is contained. The answer has a row for each pair; contained gives the present
    ones without making pairs.
    """
    m = mers.select(canonical_text(F.col("mer")).alias("_c") if spec.canonical else F.col("mer").alias("_c"), "mer").distinct()
    p = positions(m.select("mer", F.col("mer").alias("seq")), spec).distinct()
    want = m.select("mer").join(p.groupBy("mer").agg(F.count("*").alias("need")), "mer", "left").fillna(0, ["need"])
    got = p.join(bits, "pos").groupBy("filter_id", "mer").agg(F.count("*").alias("got"))
    pairs = filters.select("filter_id").join(want)  # the answer itself has a row for each pair
    return pairs.join(got, ["filter_id", "mer"], "left").select("filter_id", "mer", (F.coalesce("got", F.lit(0)) == F.col("need")).alias("present"))

"""Containment search: which filters hold at least a share theta of a query's k-mers.

A tree of filters only prunes the search and never changes its answer, so the search is one flat plan: positions of
the queries, combined with their multiplicities, are joined to the bits of the filters and summed. Where the query
side is counted to be small it is broadcast, and only bits that some query asks for are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rates import adjusted_hits, false_positive_rate, needed, needed_to_fail
from ..plans.sizes import checked
from .kmers import FilterSpec, kmers, packed_counts, position_column, positions


def query_positions(queries: DataFrame, spec: FilterSpec, distinct: bool = False) -> DataFrame:
    """batch_ix, pos, c: positions of the queries and how often each occurs (once if distinct, by position)."""
    if spec.num_hashes != 1:
        raise ValueError("filters that are searched have one hash")
    p = positions(queries.select("batch_ix", "seq"), spec).groupBy("batch_ix", "pos")
    return p.agg((F.lit(1).cast("long") if distinct else F.count("*")).alias("c"))


def query_sizes(queries: DataFrame, qpos: DataFrame) -> DataFrame:
    """batch_ix, name, n, need, need_fail: searchable k-mers and the hits needed; n 0 for queries without any."""
    n = queries.select("batch_ix", "name", "threshold").join(qpos.groupBy("batch_ix").agg(F.sum("c").alias("n")), "batch_ix", "left").fillna(0, ["n"])
    return n.select("batch_ix", "name", "n", needed(F.col("threshold"), F.col("n")).alias("need"), needed_to_fail(F.col("threshold"), F.col("n")).alias("need_fail"))


def hit_counts(qpos: DataFrame, bits: DataFrame) -> DataFrame:
    """batch_ix, filter_id, hits for the pairs that share a position."""
    q, few = checked(qpos)
    b = bits.select("filter_id", "pos")
    return b.join(q, "pos").groupBy("batch_ix", "filter_id").agg(F.sum("c").alias("hits"))


def search(queries: DataFrame, filters: DataFrame, bits: DataFrame, spec: FilterSpec, distinct: bool = False, adjust: bool = False) -> DataFrame:
    """batch_ix, name, filter_id, hits, n (and adjusted_hits) of all matches.

    queries: batch_ix, name, seq, threshold. A query without searchable k-mers has no match; at theta 0 all filters
    match every other query. Adjusting needs the set sizes of the filters.
    """
    qpos = query_positions(queries, spec, distinct).persist()  # a few rows for each query, read three times
    sizes = query_sizes(queries, qpos).where("n > 0")
    m = hit_counts(qpos, bits).join(sizes, "batch_ix").where("hits >= need")
    m = m.select("batch_ix", "name", "filter_id", "hits", "n")
    free = sizes.where("need = 0")
    if queries.where("threshold = 0").limit(1).count():
        every = free.join(filters.select("filter_id")).join(m.select("batch_ix", "filter_id", "hits"), ["batch_ix", "filter_id"], "left")
        m = m.join(free.select("batch_ix"), "batch_ix", "left_anti").unionByName(every.select("batch_ix", "name", "filter_id", F.coalesce("hits", F.lit(0)).alias("hits"), "n"))
    return with_adjusted(m, filters) if adjust else m


def with_adjusted(matches: DataFrame, filters: DataFrame) -> DataFrame:
    """matches with adjusted_hits, by each filter's number of bits and set size; an unknown set size is an error."""
    f = filters.select("filter_id", "num_bits", F.when(F.col("set_size").isNotNull(), F.col("set_size")).otherwise(F.raise_error(F.lit("a filter's set size is not known"))).alias("set_size"))
    rate = false_positive_rate(1, F.col("num_bits"), F.col("set_size"))
    return matches.join(f, "filter_id").withColumn("adjusted_hits", adjusted_hits(F.col("hits"), F.col("n"), rate)).drop("num_bits", "set_size")


def ranked(matches: DataFrame, by: str | None = "hits", order: DataFrame | None = None) -> DataFrame:
    """matches with rank from 1 within each query: by hits (or adjusted_hits) descending, then filter; or, with by
    None, in the order of a DataFrame filter_id, ord (such as the leaves of a tree in pre-order)."""
    if by is None:
        m = matches.join(order, "filter_id")
        return m.withColumn("rank", F.row_number().over(W.partitionBy("batch_ix").orderBy("ord"))).drop("ord")
    return matches.withColumn("rank", F.row_number().over(W.partitionBy("batch_ix").orderBy(F.col(by).desc(), "filter_id")))


def match_counts(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """batch_ix, name, n_matches for every query, also those without a match."""
    return queries.select("batch_ix", "name").join(matches.groupBy("batch_ix").agg(F.count("*").alias("n_matches")), "batch_ix", "left").fillna(0, ["n_matches"])


def all_hits(queries: DataFrame, filters: DataFrame, bits: DataFrame, spec: FilterSpec, distinct: bool = False) -> DataFrame:
    """batch_ix, name, filter_id, hits, n, is_hit for every pair of a query with k-mers and a simple filter."""
    if filters.where("kind <> 'simple'").limit(1).count():
        raise ValueError("counting all hits needs simple filters")
    qpos = query_positions(queries, spec, distinct).persist()
    sizes = query_sizes(queries, qpos).where("n > 0")
    pairs = sizes.join(filters.select("filter_id"))  # the answer itself has a row for each pair
    h = pairs.join(hit_counts(qpos, bits), ["batch_ix", "filter_id"], "left").fillna(0, ["hits"])
    return h.select("batch_ix", "name", "filter_id", "hits", "n", (F.col("hits") >= F.col("need")).alias("is_hit"))


def kmer_counts(queries: DataFrame, spec: FilterSpec, distinct: bool = False) -> DataFrame:
    """batch_ix, name, n: searchable k-mers of each query."""
    return query_sizes(queries, query_positions(queries, spec, distinct)).select("batch_ix", "name", "n")


def kmer_presence(queries: DataFrame, filters: DataFrame, bits: DataFrame, specs: dict[str, FilterSpec]) -> DataFrame:
    """filter_id, name, mer, present of every k-mer occurrence in each of a few filters, each with its own parameters."""
    out = None
    for filter_id, spec in specs.items():
        m = kmers(queries.select("name", "seq"), spec.k).withColumn("pos", position_column(F.col("mer"), spec))
        own = bits.where(F.col("filter_id") == filter_id).select("pos", F.lit(True).alias("_set"))
        one = m.join(own, "pos", "left").select(F.lit(filter_id).alias("filter_id"), "name", "mer", F.col("_set").isNotNull().alias("present"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no filters")
    return out


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """query, in_both, in_1_only, in_2_only of two results (query, hit)."""
    j = a.select("query", "hit", F.lit(1).alias("x")).distinct().join(b.select("query", "hit", F.lit(1).alias("y")).distinct(), ["query", "hit"], "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return j.groupBy("query").agg(n(both).alias("in_both"), n(F.col("y").isNull()).alias("in_1_only"), n(F.col("x").isNull()).alias("in_2_only"))


def exact_search(queries: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """The same search on k-mers themselves, without hashing: a control. sets: filter_id and distinct k-mers, packed
    (code, k of 31 or fewer) or as text (mer)."""
    if "code" in sets.columns:
        q = packed_counts(queries, k, "batch_ix", canonical=False).select("batch_ix", F.col("code").alias("mer"), F.col("n").alias("c"))
        sets = sets.select("filter_id", F.col("code").alias("mer"))
    else:
        q = kmers(queries.select("batch_ix", "seq"), k).groupBy("batch_ix", "mer").agg(F.count("*").alias("c"))
    q = q.persist()
    n = queries.select("batch_ix", "name", "threshold").join(q.groupBy("batch_ix").agg(F.sum("c").alias("n")), "batch_ix")
    small, _ = checked(q)
    h = sets.join(small, "mer").groupBy("batch_ix", "filter_id").agg(F.sum("c").alias("hits"))
    return h.join(n, "batch_ix").where(F.col("hits") >= needed(F.col("threshold"), F.col("n"))).select("batch_ix", "name", "filter_id", "hits", "n")

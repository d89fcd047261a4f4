"""Registered queries over the driver's tables, each with equivalent SQL where SQL can express it.

Text tables stand in for sequences: documents of a source are an experiment, benchmark passages are queries, and
letters are read as nucleotides. Bit vectors come from lineitem (a vector for each ship year, a bit for each part key),
and trees from the geography: region over nation, a nation's leaf holding the part keys its suppliers shipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, rates, sequences
from ..operators import bits as B
from ..operators import cluster as C
from ..operators import distance as D
from ..operators import filters as FL
from ..operators import inspection as I
from ..operators import kmers as K
from ..operators import search as S
from ..operators import tree as T
from ..sources import filters as sources
from ..sources import topology
from .sizes import index_folder

SPEC = K.FilterSpec(k=20, num_bits=800_000)
SAMPLED = K.FilterSpec(k=20, num_bits=200_000, modulus=800_000)
TWO = K.FilterSpec(k=20, num_bits=4_000_000, num_hashes=2, seed1=0, seed2=1)
THETA = 0.7
VECTOR_BITS, TREE_BITS = 4096, 16384


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def experiments(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("source").alias("filter_id"), sequences.text_to_nucleotides(F.col("text")).alias("seq"))


def passages(spark: SparkSession, d: str, theta: float = THETA) -> DataFrame:
    b = t(spark, d, "benchmark")
    return b.select(F.col("item_id").cast("int").alias("batch_ix"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), sequences.text_to_nucleotides(F.col("text")).alias("seq"), F.lit(theta).alias("threshold"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem")
    return li.select(F.concat(F.lit("y"), F.year("l_shipdate").cast("string")).alias("vec"), (F.col("l_partkey") % VECTOR_BITS).alias("pos")).distinct()


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A small tree in pre-order: root, regions by key, nations by key under them."""
    regions = [(r.r_regionkey, r.r_name) for r in t(spark, d, "region").orderBy("r_regionkey").collect()]  # 5 rows
    nations = [(n.n_regionkey, n.n_name) for n in t(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    lines = ["root"]
    for key, name in regions:
        lines += [f"*R_{name.replace(' ', '_')}"] + [f"**N_{n.replace(' ', '_')}" for k, n in nations if k == key]
    return spark.createDataFrame(topology.parse(lines), topology.NODE_SCHEMA)


def leaf_bits(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    leaf = F.concat(F.lit("N_"), F.replace("n_name", F.lit(" "), F.lit("_")))
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(leaf.alias("filter_id"), (F.col("l_partkey") * 7 % TREE_BITS).alias("pos")).distinct()


def brand_positions(spark: SparkSession, d: str) -> DataFrame:
    """Queries for the tree: the parts of each brand."""
    p = t(spark, d, "part").select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("batch_ix"), (F.col("p_partkey") * 7 % TREE_BITS).alias("pos"))
    return p.groupBy("batch_ix", "pos").agg(F.count("*").alias("c"))


def brand_sizes(spark: SparkSession, d: str, qpos: DataFrame, theta: float = 0.9) -> DataFrame:
    n = qpos.groupBy("batch_ix").agg(F.sum("c").alias("n"))
    return n.select("batch_ix", "n", rates.needed(theta, F.col("n")).alias("need"), rates.needed_to_fail(theta, F.col("n")).alias("need_fail"))


def _filters(spark: SparkSession, d: str, spec: K.FilterSpec = SPEC) -> tuple[DataFrame, DataFrame]:
    return FL.build(experiments(spark, d), spec)


def _bits(spark: SparkSession, d: str, spec: K.FilterSpec = SPEC) -> DataFrame:
    return _filters(spark, d, spec)[1]


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = tree_nodes(spark, d)
    closure = topology.closure(nodes)
    return nodes, closure, T.node_counts(F.broadcast(closure), leaf_bits(spark, d))  # the closure has 75 rows


def _active(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, closure, counts = _tree(spark, d)
    return nodes, T.active(spark, counts, nodes, closure, TREE_BITS)


# Sequences and filters


def kmer_counts(spark, d):
    m = K.packed_counts(experiments(spark, d), 20, "filter_id", canonical=False)
    return m.groupBy("filter_id").agg(F.sum("n").alias("kmers"), F.count("*").alias("distinct_kmers"))


def kmer_min_abundance(spark, d):
    c = K.packed_counts(experiments(spark, d), 20, "filter_id", least=2)
    return c.groupBy("filter_id").agg(F.count("*").alias("kept"), F.sum("n").alias("occurrences"), F.max("n").alias("most"))


def kmer_hashes(spark, d):
    m = K.kmers(passages(spark, d), 20, keep=["batch_ix"])
    h = hashing.hash_column(F.col("mer"), 20)
    return m.select("batch_ix", "mer", F.lpad(F.hex(h), 16, "0").alias("h"), hashing.unsigned_mod(h, SPEC.range).alias("pos"), F.lpad(F.hex(hashing.hash_column(F.col("mer"), 20, 1)), 16, "0").alias("h_seed1"), F.lpad(F.hex(hashing.hash_column(F.col("mer"), 20, 0, False)), 16, "0").alias("h_forward"))


def filter_positions(spark, d):
    return _bits(spark, d).groupBy("filter_id").agg(F.count("*").alias("ones"), F.min("pos").alias("lowest"), F.max("pos").alias("highest"), F.sum("pos").alias("total"))


def filter_stats(spark, d):
    f, _ = _filters(spark, d)
    return FL.stats(f).withColumn("bf_fp_rate", F.round("bf_fp_rate", 9))


def theta_query(spark, d):
    f, b = _filters(spark, d)
    return S.search(passages(spark, d), f, b, SPEC)


def theta_query_distinct(spark, d):
    f, b = _filters(spark, d)
    return S.search(passages(spark, d), f, b, SPEC, distinct=True)


def theta_query_sampled(spark, d):
    f, b = _filters(spark, d, SAMPLED)
    return S.search(passages(spark, d), f, b, SAMPLED)


def theta_query_adjusted(spark, d):
    f, b = _filters(spark, d)
    return S.ranked(S.search(passages(spark, d, 0.5), f, b, SPEC, adjust=True), "adjusted_hits")


def theta_query_counts(spark, d):
    q = passages(spark, d)
    f, b = _filters(spark, d)
    return S.match_counts(q, S.search(q, f, b, SPEC))


def count_all_hits(spark, d):
    f, b = _filters(spark, d)
    return S.all_hits(passages(spark, d), f, b, SPEC)


def query_kmer_counts(spark, d):
    return S.kmer_counts(passages(spark, d), SPEC)


def query_filter_kmers(spark, d):
    _, b = _filters(spark, d)
    p = S.kmer_presence(passages(spark, d), None, b, {"src1": SPEC, "src2": SPEC})
    return p.groupBy("filter_id", "name", "mer", "present").agg(F.count("*").alias("n"))


def multi_hash_contains(spark, d):
    f, b = _filters(spark, d, TWO)
    m = K.kmers(passages(spark, d), 20, keep=[]).distinct()
    return FL.contained(m, f.select("filter_id"), b, TWO).groupBy("filter_id").agg(F.count("*").alias("contained"))


def exact_theta_query(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("filter_id"), sequences.text_to_nucleotides(F.col("text")).alias("seq"))
    sets = K.packed_counts(docs, 20, "filter_id", canonical=False).select("filter_id", "code")
    return S.exact_search(passages(spark, d), sets, 20)


def sequence_functions(spark, d):
    p = passages(spark, d)
    m = K.kmers(p, 20, keep=["batch_ix"])
    return m.select("batch_ix", "mer", sequences.reverse_complement(F.col("mer")).alias("rc"), K.canonical_text(F.col("mer")).alias("canonical"), hashing.packed(F.col("mer")).alias("packed"), sequences.is_acgt(F.col("mer")).alias("ok"))


def name_functions(spark, d):
    p = t(spark, d, "pages").select("page_id", F.concat("url", F.lit("/x.detbrief.rrr.unity.bf")).alias("path"))
    return p.select("page_id", sequences.strip_file_path(F.col("path")).alias("file"), sequences.filter_name(F.col("path")).alias("name"), sequences.strip_suffix(F.col("path"), ".bf").alias("no_suffix"), sequences.strip_prefix(F.col("path"), "https://").alias("no_prefix"), F.size(sequences.comma_list(F.lit("a, b,c"))).alias("n_fields"))


def position_checksum(spark, d):
    q = K.positions(passages(spark, d).select("batch_ix", "seq"), SPEC)
    return K.checksum(q, ["batch_ix"])


# Bit vectors


def _unary(f):
    return lambda spark, d: f(spark, vectors(spark, d))


bits_and = _unary(lambda s, v: B.intersection(v, ["y1995", "y1996", "y1997"]))
bits_or = _unary(lambda s, v: B.union(v, ["y1995", "y1996", "y1997"]))
bits_xor = _unary(lambda s, v: B.parity(v, ["y1995", "y1996", "y1997"]))
bits_eq = _unary(lambda s, v: B.equal(s, v, "y1995", "y1996", VECTOR_BITS))
bits_not = _unary(lambda s, v: B.complement(s, v.where("vec = 'y1995'"), VECTOR_BITS))
bits_mask = _unary(lambda s, v: B.mask(v, "y1995", "y1996"))
bits_ornot = _unary(lambda s, v: B.or_not(s, v, "y1995", "y1996", VECTOR_BITS))
bits_squeeze = _unary(lambda s, v: B.squeeze(v.where("vec = 'y1995'").select("pos"), v.where("vec = 'y1996'")))
bits_unsqueeze = _unary(lambda s, v: B.unsqueeze(v.where("vec = 'y1995'").select("pos"), v.where("vec = 'y1996'")))
bits_rank = _unary(lambda s, v: B.rank1(v.where("vec = 'y1995'"), s.range(0, VECTOR_BITS + 1, 64).select(F.col("id").alias("n")), VECTOR_BITS, chunk=512))
bits_select1 = _unary(lambda s, v: B.select1(v, ["vec"]))
bits_select0 = _unary(lambda s, v: B.select0(s, v.where("vec = 'y1995'"), VECTOR_BITS))
bits_simplify = _unary(lambda s, v: B.simplify(v, v.select("vec"), VECTOR_BITS))
bits_density = _unary(lambda s, v: B.density(v, VECTOR_BITS, 100, 1100))
bits_counts = _unary(lambda s, v: B.counts(v, "y1995", "y1996", VECTOR_BITS))
bits_bitmaps = _unary(lambda s, v: B.bucket_ones(B.union_buckets(B.to_buckets(v.where("vec in ('y1995', 'y1996')")))))
bits_dump = _unary(lambda s, v: I.dump(v, ["vec"], VECTOR_BITS, 0, 100))
bits_integers = _unary(lambda s, v: I.integers(v, ["vec"]))
distance_hamming = _unary(lambda s, v: D.distances(v, "hamming"))
distance_intersection = _unary(lambda s, v: D.distances(v, "intersection", start=8, end=2000))
distance_union = _unary(lambda s, v: D.distances(v, "union"))
distance_jaccard = _unary(lambda s, v: D.distances(v, "jaccard").withColumn("jaccard", F.round("jaccard", 9)))
distance_theta = _unary(lambda s, v: D.distances(v, "theta", focus=v.where("vec = 'y1995'").select("vec")).withColumn("theta", F.round("theta", 9)))
random_vector = _unary(lambda s, v: B.density(FL.random_vector(s, 100_000, 0.1, 7).withColumn("vec", F.lit("random")), 100_000))

# Trees


def node_union(spark, d):
    return T.union_tree(_tree(spark, d)[2])


def node_intersection(spark, d):
    return T.intersection_tree(_tree(spark, d)[2])


def node_allsome(spark, d):
    nodes, _, counts = _tree(spark, d)
    return T.allsome_tree(counts, nodes)


def node_determined(spark, d):
    return T.determined_tree(_active(spark, d)[1])


def node_brief(spark, d):
    return T.brief_tree(_active(spark, d)[1])


def brief_lengths(spark, d):
    return T.brief_lengths(_active(spark, d)[1])


def tree_lookup(spark, d):
    nodes, _, counts = _tree(spark, d)
    asked = nodes.select(F.col("name").alias("node")).join(spark.range(TREE_BITS).withColumnRenamed("id", "pos"))
    return T.lookup(counts, asked, "determined,brief", nodes)


def tree_search(spark, d):
    q = brand_positions(spark, d)
    nodes, closure, counts = _tree(spark, d)
    s = T.node_query_stats(q, brand_sizes(spark, d, q), counts, nodes, complete=False)
    return T.matching_leaves(s, closure)


def nodes_examined(spark, d):
    q = brand_positions(spark, d)
    nodes, _, counts = _tree(spark, d)
    return T.nodes_examined(T.node_query_stats(q, brand_sizes(spark, d, q), counts, nodes, complete=False))


def node_query_stats(spark, d):
    q = brand_positions(spark, d)
    nodes, _, counts = _tree(spark, d)
    return T.node_query_stats(q, brand_sizes(spark, d, q), counts, nodes)


def det_ratio(spark, d):
    nodes, _, counts = _tree(spark, d)
    return C.determined_ratios(counts, nodes, TREE_BITS)


def cull_threshold(spark, d):
    nodes, _, counts = _tree(spark, d)
    return C.cull_threshold(C.determined_ratios(counts, nodes, TREE_BITS), nodes, 1.0).select(F.round("threshold", 9).alias("threshold"))


def node_stats(spark, d):
    nodes, closure, _ = _tree(spark, d)
    return I.node_stats(nodes, closure)


def bit_stats(spark, d):
    return I.bit_stats(_active(spark, d)[1])


def allsome_stats(spark, d):
    nodes, _, counts = _tree(spark, d)
    return I.allsome_stats(T.allsome_tree(counts, nodes), nodes, TREE_BITS)


def forest_stats(spark, d):
    """The tree without its root, a forest of regions."""
    nodes = tree_nodes(spark, d).where("depth > 0")
    return I.forest_stats(nodes.withColumn("parent_ix", F.when(F.col("depth") > 1, F.col("parent_ix"))))


def topology_lines(spark, d):
    return topology.lines(tree_nodes(spark, d), "name")


def depth_histogram(spark, d):
    return C.depth_histogram(tree_nodes(spark, d))


def tree_validation(spark, d):
    """A union tree with an error planted: a region has lost the positions that five divides."""
    nodes, _, counts = _tree(spark, d)
    return T.union_differences(T.union_tree(counts).where("node <> 'R_ASIA' or pos % 5 <> 0"), nodes)


def tree_names(spark, d):
    """Names of nodes against filters: one filter lost, one without a node, one node repeated."""
    nodes = tree_nodes(spark, d)
    named = nodes.select("name").unionByName(nodes.where("name = 'R_AFRICA'").select("name"))
    ids = nodes.where("name <> 'R_EUROPE'").select(F.col("name").alias("filter_id")).unionByName(spark.range(1).select(F.lit("N_ATLANTIS").alias("filter_id")))
    return T.invalid_names(named, ids)


def lonely_nodes(spark, d):
    """Only children where each region keeps the nations whose key leaves a remainder below two."""
    nodes = tree_nodes(spark, d)
    keys = t(spark, d, "nation").where("n_nationkey % 7 < 2").select(F.concat(F.lit("N_"), F.replace("n_name", F.lit(" "), F.lit("_"))).alias("name"))
    return T.only_children(nodes.where("depth < 2").unionByName(nodes.join(keys, "name", "left_semi").select(nodes.columns)))


_INDEX: dict[tuple[str, str], str] = {}


def stored_index(spark, d):
    """The filters of the experiments, written once for each application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEX:
        path = index_folder(spark)
        sources.write(*_filters(spark, d), path)
        _INDEX[key] = path
    return sources.read(spark, _INDEX[key])


def theta_query_stored(spark, d):
    return S.search(passages(spark, d), *stored_index(spark, d), SPEC)


def theta_query_in_tree_order(spark, d):
    """Ranked by the order of the leaves of a tree, here names from the last to the first."""
    f, b = _filters(spark, d)
    order = f.select("filter_id", (-F.row_number().over(W.orderBy("filter_id"))).alias("ord"))
    return S.ranked(S.search(passages(spark, d), f, b, SPEC), None, order)


def theta_zero(spark, d):
    f, b = _filters(spark, d)
    return S.search(passages(spark, d, 0.0), f, b, SPEC)


def min_abundance_positions(spark, d):
    _, b = FL.build(experiments(spark, d), SPEC, least=2)
    return b.groupBy("filter_id").agg(F.count("*").alias("ones"), F.min("pos").alias("lowest"), F.max("pos").alias("highest"), F.sum("pos").alias("total"))


def max_depth(spark, d):
    return I.max_depth(tree_nodes(spark, d))


def renumbered_tree(spark, d):
    return topology.lines(I.renumbered(tree_nodes(spark, d)), "name")


def sibling_groups(spark, d):
    return I.siblings(tree_nodes(spark, d)).select(F.array_join("names", " ").alias("names"))


def subtree_nodes(spark, d):
    return I.subtree(tree_nodes(spark, d), "R_EUROPE").select("name")


def bit_stats_view(spark, d):
    return I.bit_stats_view(I.bit_stats(_active(spark, d)[1])).withColumn("s_x", F.round("s_x", 9))


def allsome_totals(spark, d):
    nodes, _, counts = _tree(spark, d)
    s = I.allsome_totals(I.allsome_stats(T.allsome_tree(counts, nodes), nodes, TREE_BITS))
    return s.withColumns({c: F.round(c, 6) for c in ("present_pct", "absent_pct")})


def node_stat_items(spark, d):
    """Statistics of nodes with the items and rates of their filters and the ones of their vectors."""
    nodes, closure, counts = _tree(spark, d)
    bits = leaf_bits(spark, d)
    filters = FL.describe(bits.groupBy("filter_id").agg(F.count("*").alias("set_size")), K.FilterSpec(num_bits=TREE_BITS))
    s = I.node_stats(nodes, closure, filters, T.allsome_tree(counts, nodes))
    return s.where("items is not null").select("node", "items", F.round("fp_rate", 9).alias("fp_rate"), F.coalesce(F.col("ones")["all"], F.lit(0)).alias("n_all"), F.coalesce(F.col("ones")["some"], F.lit(0)).alias("n_some"))


def constant_filters(spark, d):
    """Filters of ones and of zeros like those of the experiments."""
    spec = K.FilterSpec(num_bits=VECTOR_BITS)
    out = [FL.constant(spark, name, spec, ones)[1] for name, ones in (("full", True), ("none", False))]
    return B.density(vectors(spark, d).unionByName(out[0].unionByName(out[1]).select(F.col("filter_id").alias("vec"), "pos")), VECTOR_BITS)


def random_vector_exact(spark, d):
    return B.density(FL.random_vector(spark, 100_000, seed=7, ones=12_345).withColumn("vec", F.lit("random")), 100_000)


def cluster_topology(spark, d):
    return C.cluster(vectors(spark, d).select(F.col("vec").alias("filter_id"), "pos"), 0, VECTOR_BITS).drop("tags")


# Results and sizes


def compare_results(spark, d):
    f, b = _filters(spark, d)
    low = S.search(passages(spark, d, 0.5), f, b, SPEC).select(F.col("name").alias("query"), F.col("filter_id").alias("hit"))
    fs, bs = _filters(spark, d, SAMPLED)
    high = S.search(passages(spark, d, 0.6), fs, bs, SAMPLED).select(F.col("name").alias("query"), F.col("filter_id").alias("hit"))
    return S.compare(low, high)


def filter_size(spark, d):
    n = t(spark, d, "documents").groupBy("source").agg(F.count_distinct("doc_id").alias("n"))
    return n.select("source", rates.filter_size(F.col("n"), 0.1).alias("bits_1"), rates.filter_size(F.col("n"), 0.1, 3).alias("bits_3"))


def query_fp_bound(spark, d):
    q = S.kmer_counts(passages(spark, d), SPEC)
    return q.select("batch_ix", F.round(rates.query_rate_bound(F.col("n"), 0.2, F.lit(0.1)), 12).alias("bound"), rates.needed(THETA, F.col("n")).alias("need"), rates.needed_to_fail(THETA, F.col("n")).alias("need_fail"))


QUERIES = {f.__name__: f for f in (
    kmer_counts, kmer_min_abundance, kmer_hashes, filter_positions, filter_stats, theta_query, theta_query_distinct, theta_query_sampled, theta_query_adjusted, theta_query_counts,
    count_all_hits, query_kmer_counts, query_filter_kmers, multi_hash_contains, exact_theta_query, sequence_functions, name_functions, position_checksum,
    node_union, node_intersection, node_allsome, node_determined, node_brief, brief_lengths, tree_lookup, tree_search, nodes_examined, node_query_stats, det_ratio, cull_threshold,
    node_stats, bit_stats, allsome_stats, forest_stats, topology_lines, depth_histogram, tree_validation, tree_names, lonely_nodes, cluster_topology,
    theta_query_stored, theta_query_in_tree_order, theta_zero, min_abundance_positions, max_depth, renumbered_tree, sibling_groups, subtree_nodes, bit_stats_view, allsome_totals,
    node_stat_items, constant_filters, random_vector_exact, compare_results, filter_size, query_fp_bound,
)} | {n: globals()[n] for n in (
    "bits_and", "bits_or", "bits_xor", "bits_eq", "bits_not", "bits_mask", "bits_ornot", "bits_squeeze", "bits_unsqueeze", "bits_rank", "bits_select1", "bits_select0", "bits_simplify",
    "bits_density", "bits_counts", "bits_bitmaps", "bits_dump", "bits_integers", "distance_hamming", "distance_intersection", "distance_union", "distance_jaccard", "distance_theta", "random_vector",
)}

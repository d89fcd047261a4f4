import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import gramlode
from gramlode.functions import hashing, rates
from gramlode.operators import cluster as C
from gramlode.operators import filters as FL
from gramlode.operators import inspection as I
from gramlode.operators import search as S
from gramlode.operators import tree as T
from gramlode.operators.kmers import FilterSpec, count_kmers, kmers, packed_counts, packed_positions, positions
from gramlode.sources import filters as SF
from gramlode.sources import results, sequences, topology

LINES = ["r", "*a", "**b", "**c", "*d", "**e", "***f", "***g", "**h"]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(topology.parse(LINES), topology.NODE_SCHEMA)


def test_packed_kmers_equal_their_letters(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i % 3, "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(120))) for i in range(20)] + [(1, None), (2, "")], "f int, seq string")
    spec = FilterSpec(k=9, num_bits=3000, modulus=4000, num_hashes=3, seed1=2, seed2=5)
    for canonical in (True, False):
        want = count_kmers(kmers(df, 9), ["f"], canonical).select("f", hashing.packed(F.col("mer")).alias("code"), "n")
        assert {tuple(r) for r in packed_counts(df, 9, "f", canonical=canonical).collect()} == {tuple(r) for r in want.collect()}
    codes = packed_counts(df, 9, "f")
    assert {tuple(r) for r in packed_positions(codes, spec, "f").collect()} == {tuple(r) for r in positions(df, spec, keep=["f"]).collect()}
    with pytest.raises(ValueError):
        packed_counts(df, 32, "f")


def test_more_than_two_hashes():
    h1, h2 = (np.array([x], np.uint64) for x in (hashing.hash_kmer("ACGTACGTACG", 0), hashing.hash_kmer("ACGTACGTACG", 1)))
    got = [int(x[0]) for x in hashing.more_hashes(h1, h2, 5)]
    want, a, b = [int(h1[0]), int(h2[0])], int(h1[0]), int(h2[0])
    while len(want) < 5:  # the published generator, on Python integers
        x = (b ^ b << 23) & hashing.MASK
        a, b = x, x ^ a ^ x >> 17 ^ a >> 26
        want.append(b)
    assert got == want


def test_checksums_in_chunks(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(I, "CHECKSUM_BITS", 64)
    for n in (1, 63, 64, 65, 500):
        on = [p for p in range(n) if rng.random() < 0.2] or [0]
        v = spark.createDataFrame([("v", p) for p in on], "vec string, pos long")
        assert I.checksum(v, ["vec"], n).first().checksum == hashing.bit_checksum("".join("1" if i in on else "0" for i in range(n)))


def test_lists_subsets_and_queries_of_a_table(spark, tmp_path):
    (tmp_path / "l").write_text("x\n\n  z \n")
    (tmp_path / "r.fa").write_text(">x 1\nAC\n>y 2\nGG\n>z\nTT\n")
    names = sequences.read_list(spark, f"{tmp_path}/l")
    assert sorted(r.name for r in names.collect()) == ["x", "z"]
    some = sequences.subset_by_name(sequences.read_fasta(spark, f"{tmp_path}/r.fa"), names)
    assert sorted(r.seq for r in some.collect()) == ["AC", "TT"]
    q = sequences.queries_from(spark.createDataFrame([(f"q{i:03d}", "ACGT") for i in range(50)], "n string, s string").repartition(5), "n", "s", 0.5)
    assert [(r.batch_ix, r.name) for r in q.orderBy("batch_ix").collect()] == [(i, f"q{i:03d}") for i in range(50)]


def test_groups_consistency_and_vectors(spark, tmp_path):
    s = spark.createDataFrame([("x", "ACGTACGTAC"), ("y", "GGGGGGGGGG")], "filter_id string, seq string")
    f, b = FL.build(s, FilterSpec(k=4, num_bits=1000))
    FL.check_consistent(f)
    with pytest.raises(ValueError):
        FL.check_consistent(f.unionByName(FL.build(s, FilterSpec(k=5, num_bits=1000))[0]))
    SF.write_by_group(b, spark.createDataFrame([("x", 1), ("y", 2)], "filter_id string, grp int"), f"{tmp_path}/g")
    assert {(r.filter_id, r.grp) for r in spark.read.parquet(f"{tmp_path}/g").collect()} == {("x", 1), ("y", 2)}
    assert FL.spec_of(f, "x") == FilterSpec(4, 1000, 1000) and FL.build_vectors(s, 4, 1000)[1].count() == 2
    with pytest.raises(ValueError):
        FL.spec_of(f, "none")
    for ones, n in ((True, 1000), (False, 0)):
        assert FL.constant(spark, "c", FilterSpec(num_bits=1000), ones)[1].count() == n
    assert FL.random_vector(spark, 5000, ones=321).count() == 321 and FL.random_vector(spark, 5000, 0.2, 3).count() == FL.random_vector(spark, 5000, 0.2, 3).count()
    listed = FL.build_from_kmers(spark.createDataFrame([("k", "ACGT"), ("k", "ACGT")], "filter_id string, mer string"), FilterSpec(k=4, num_bits=1000))
    assert listed[0].first().set_size == 2 and listed[1].count() == 1
    want = FL.contains(spark.createDataFrame([("ACGT",), ("TTTT",), ("GGGG",)], "mer string"), f, b, FilterSpec(k=4, num_bits=1000)).where("present").select("filter_id", "mer")
    got = FL.contained(spark.createDataFrame([("ACGT",), ("TTTT",), ("GGGG",)], "mer string"), f, b, FilterSpec(k=4, num_bits=1000))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_header_text():
    props = {"kind": "simple", "k": 20, "num_hashes": 1, "seed1": 0, "seed2": 0, "modulus": 64, "num_bits": 64, "set_size": None}
    lines = SF.header_lines(SF.build_file(props, [np.array([1])]))
    assert "kind: simple" in lines and "set_size: unknown" in lines and lines[-1].startswith("vector 0: uncompressed")


def test_result_texts_of_all_forms(spark):
    q = spark.createDataFrame([(0, "a")], "batch_ix int, name string")
    m = spark.createDataFrame([(0, "x", 1, 3, 4, 2, True), (0, "y", 2, 1, 4, 0, False)], "batch_ix int, leaf string, rank int, hits long, n long, adjusted_hits long, is_hit boolean")
    text = lambda **k: [r.line for r in results.lines(q, m, **k).orderBy("batch_ix", "line_ix").collect()]
    assert text(counts=True, adjusted=True)[1] == "x 3/4 0.750000 2/4 0.500000"
    assert text(backward=True) == ["a x", "a y"]
    assert text(all_hits=True) == ["*a 1", "a vs x 3/4 0.750000 hit", "a vs y 1/4 0.250000"]
    assert results.kmer_count_lines(spark.createDataFrame([(0, "a", 7)], "batch_ix int, name string, n long")).first().line == "a 7"
    p = spark.createDataFrame([("f", "a", "ACGT", True), ("f", "a", "TTTT", False)], "filter_id string, name string, mer string, present boolean")
    assert sorted(r.line for r in results.presence_lines(p).collect()) == ["f a ACGT present", "f a TTTT absent"]


def test_node_query_counts_and_their_text(spark, nodes):
    rng = random.Random(4)
    leaves = [r.name for r in topology.leaves(nodes).collect()]
    bits = {x: {p for p in range(30) if rng.random() < 0.6} for x in leaves}
    counts = T.node_counts(topology.closure(nodes), spark.createDataFrame([(x, p) for x, s in bits.items() for p in s], "filter_id string, pos long"))
    asked = list(range(0, 30, 2))
    qpos = spark.createDataFrame([(0, p, 1) for p in asked], "batch_ix int, pos long, c long")
    s = T.node_query_stats(qpos, spark.createDataFrame([(0, 15, 9, 7)], "batch_ix int, n long, need long, need_fail long"), counts, nodes)
    under = {}
    for r in topology.closure(nodes).collect():
        under.setdefault(r.node, []).append(bits[r.leaf])
    parent = {r.node: r.parent for r in T.parents(nodes).collect()}
    ok = {n: sum(all(p in x for x in v) for p in asked) for n, v in under.items()}
    no = {n: sum(all(p not in x for x in v) for p in asked) for n, v in under.items()}
    for r in s.collect():
        up = parent[r.node]
        assert (r.n_pass, r.n_fail, r.local_pass, r.local_fail) == (ok[r.node], no[r.node], ok[r.node] - ok.get(up, 0), no[r.node] - no.get(up, 0))
    lines = {x.line.split("\t")[1]: x.line.split("\t") for x in results.node_stat_lines(s).collect()}
    assert lines["r"][:3] == ["0", "r", "E"] and lines["r"][4:] == [str(x) for x in (ok["r"], no["r"], ok["r"], no["r"], 15 - ok["r"] - no["r"])]
    assert all(x[4:] == ["-"] * 5 for x in lines.values() if x[2] == "-")


def test_traversals_and_parts_of_a_tree(spark, nodes):
    post = [r.name for r in topology.post_order(nodes).orderBy("post_ix").collect()]
    assert post == ["b", "c", "a", "f", "g", "e", "h", "d", "r"]
    assert [r.name for r in topology.leaves(nodes).collect()] == ["b", "c", "f", "g", "h"] and [r.name for r in topology.children(nodes, "d").collect()] == ["e", "h"]
    assert [r.line for r in topology.lines(I.renumbered(nodes), "name").orderBy("node_ix").collect()] == ["node1", "*node2", "**b", "**c", "*node3", "**node4", "***f", "***g", "**h"]
    assert {r.name for r in I.subtree(nodes, "d").collect()} == set("defgh") and I.max_depth(nodes).first().max_depth == 3
    assert {tuple(r.names) for r in I.siblings(nodes).collect()} == {("r",), ("a", "d"), ("b", "c"), ("e", "h"), ("f", "g")}
    assert T.only_children(nodes).isEmpty() and T.only_children(nodes.where("name <> 'h'")).first().name == "e"
    ids = spark.createDataFrame([(x,) for x in "abcdefgr"] + [("z",)], "filter_id string")
    assert {tuple(r) for r in T.invalid_names(nodes.select("name").union(nodes.where("name = 'a'").select("name")), ids).collect()} == {("a", "repeated"), ("h", "no filter"), ("z", "no node")}
    x = {r.name: (r.x, r.y) for r in I.tree_picture(nodes).collect()}
    assert x["b"] == (0, 2) and x["a"] == (0.5, 1) and x["r"][1] == 0
    assert T.output_name("t.sbt", "determined,brief", "rrr") == "t.detbrief.rrr.sbt"
    tagged = topology.parse(["a.bf 10 2", "*b.bf 10 3"])
    assert tagged[1][6] == ["10", "3"]


def test_culling_by_a_threshold(spark, nodes):
    ratios = spark.createDataFrame([("r", 1, 10), ("a", 9, 10), ("d", 0, 10), ("e", 5, 10), ("b", 0, 1)], "node string, n_det long, n_informative long")
    assert {r.node for r in C.fruitless(ratios, nodes, 0.3).collect()} == {"r", "d"}
    t = C.cull_threshold(ratios, nodes, 1.0).first().threshold
    v = np.array([0.1, 0.9, 0.0, 0.5])
    assert t == pytest.approx(max(0, v.mean() - v.std()))
    bits = spark.createDataFrame([(f, p) for f, ps in (("w", [0, 1]), ("x", [0, 1, 2]), ("y", [40_000, 40_001]), ("z", [40_000])) for p in ps], "filter_id string, pos long")
    names, packed = C.leaf_vectors(bits)
    assert names == list("wxyz") and np.bitwise_count(packed).sum(1).tolist() == [2, 3, 2, 1]
    assert C.agglomerate(packed)[:2] == [(0, 1), (2, 3)]
    assert C.cluster(bits, 0, 50_000, cull_sd=None).where("is_leaf").count() == 4


def test_rates_and_sizes_of_queries():
    # halves go up: of five k-mers at containment one half, three are there
    assert rates.query_false_positive_rate(5, 0.8, 0.5, 0.3) == pytest.approx(1 - 0.7**2)
    assert rates.query_false_positive_rate(4, 1.0, 0.5, 0.25) == pytest.approx(0.25**2)
    bits = rates.size_for_query_rate(1000, 4, 1.0, 0.5, 0.01)
    rate = lambda b: 1 - np.exp(-1000 / b)
    assert rates.query_false_positive_rate(4, 1.0, 0.5, rate(bits)) <= 0.01 < rates.query_false_positive_rate(4, 1.0, 0.5, rate(bits - 1))


def test_kinds_dumps_logs_and_checks(spark, tmp_path):
    s = spark.createDataFrame([("x", "ACGTACGTAC")], "filter_id string, seq string")
    spec = FilterSpec(k=4, num_bits=1000)
    f, b = FL.build(s, spec)
    q = spark.createDataFrame([(0, "q", "ACGTACGT", 0.5)], "batch_ix int, name string, seq string, threshold double")
    with pytest.raises(ValueError):
        S.all_hits(q, f.withColumn("kind", F.lit("determined")), b, spec)
    order = spark.createDataFrame([("y", 0), ("x", 1)], "filter_id string, ord int")
    assert S.ranked(S.search(q, f, b, spec), None, order).first()["rank"] == 1
    with pytest.raises(Exception, match="set size"):
        S.with_adjusted(S.search(q, f, b, spec), f.withColumn("set_size", F.lit(None).cast("long"))).collect()
    v = spark.createDataFrame([("v", 0), ("v", 3)], "vec string, pos long")
    assert I.wrapped(I.dump(v, ["vec"], 12), 6, 2).first().bits == "10 01 00\n00 00 00"
    met = I.load_test(b, 1000, 2000)
    assert met["lookups"] == 2000 and 0 <= met["met"] <= 2000 and met["seconds"] > 0
    assert I.hash_asymmetry(kmers(s, 4).select("mer"), 4).isEmpty()
    (tmp_path / "log").write_text("load x 1.5 secs\nload x 2.5 secs\nnoise\nload y 1 secs\n")
    got = {(r.key, r.n, r.total) for r in results.job_totals(spark, f"{tmp_path}/log", r"^load (\w+) ([0-9.]+) secs").collect()}
    assert got == {("x", 2, 4.0), ("y", 1, 1.0)} and gramlode.__version__

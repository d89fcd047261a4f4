import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlode.operators import bits as B
from gramlode.operators import cluster as C
from gramlode.operators import distance as D
from gramlode.operators import filters as FL
from gramlode.operators import inspection as I
from gramlode.operators import search as S
from gramlode.operators import tree as T
from gramlode.operators.kmers import FilterSpec
from gramlode.sources import topology

BITS = "11000110001110001101000111011100111010010010001010"
SPEC = "01110011011100100110111111000100110010001001100100"
SQUEEZED = "1001001101000011111110000"
UNSQUEEZED = "01000010001100000100000111000100110010000000000000"


def ones(spark, text):
    return spark.createDataFrame([(i,) for i, c in enumerate(text) if c == "1"], "pos long")


def test_squeeze_and_unsqueeze(spark):
    b, s = ones(spark, BITS), ones(spark, SPEC)
    assert B.as_text(B.squeeze(b, s), SPEC.count("1")) == SQUEEZED
    back = B.unsqueeze(B.squeeze(b, s), s)
    assert B.as_text(back, len(BITS)) == UNSQUEEZED == "".join("1" if x == y == "1" else "0" for x, y in zip(BITS, SPEC, strict=True))


def test_set_operations_and_ranks(spark):
    rng = random.Random(3)
    sets = {v: {p for p in range(300) if rng.random() < 0.4} for v in "abc"}
    v = spark.createDataFrame([(k, p) for k, s in sets.items() for p in s], "vec string, pos long")
    a, b, c = sets.values()
    got = lambda df: {r.pos for r in df.collect()}
    assert got(B.intersection(v, list("abc"))) == a & b & c and got(B.union(v, list("ab"))) == a | b and got(B.parity(v, list("abc"))) == a ^ b ^ c
    assert got(B.mask(v, "a", "b")) == a - b and got(B.equal(spark, v, "a", "b", 300)) == set(range(300)) - (a ^ b) and got(B.or_not(spark, v, "a", "b", 300)) == a | (set(range(300)) - b)
    asked = spark.range(0, 301).withColumnRenamed("id", "n")
    r = B.rank1(v.where("vec = 'a'"), asked, 300, chunk=16).collect()
    assert {x.n: x.rank1 for x in r} == {n: sum(p < n for p in a) for n in range(301)}
    assert {x.r: x.pos for x in B.select0(spark, v.where("vec = 'a'"), 300).collect()} == dict(enumerate(sorted(set(range(300)) - a)))
    d = {(x.u, x.v): x.hamming for x in D.distances(v, "hamming").collect()}
    assert d == {("a", "b"): len(a ^ b), ("a", "c"): len(a ^ c), ("b", "c"): len(b ^ c)}
    with pytest.raises(ValueError):
        B.check_lengths({"a": 3, "b": 4})


def random_tree(rng, leaves):
    lines, names = [], iter(range(1000))

    def grow(depth, n):
        if n == 1:
            lines.append("*" * depth + f"leaf{next(names)}")
            return
        lines.append("*" * depth + f"node{next(names)}")
        cut = sorted(rng.sample(range(1, n), rng.randint(1, min(3, n - 1))))
        for lo, hi in zip([0, *cut], [*cut, n], strict=True):
            grow(depth + 1, hi - lo)

    grow(0, leaves)
    return topology.parse(lines)


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_give_the_flat_answer(spark, seed):
    rng = random.Random(seed)
    rows = random_tree(rng, 7)
    nodes = spark.createDataFrame(rows, topology.NODE_SCHEMA)
    leaves = [r[3] for r in rows if r[5]]
    bits = {x: {p for p in range(40) if rng.random() < 0.6} for x in leaves}
    lb = spark.createDataFrame([(x, p) for x, s in bits.items() for p in s], "filter_id string, pos long")
    queries = {q: [rng.randrange(40) for _ in range(12)] for q in range(4)}
    qpos = spark.createDataFrame([(q, p) for q, ps in queries.items() for p in ps], "batch_ix int, pos long").groupBy("batch_ix", "pos").agg(F.count("*").alias("c"))
    need = {q: 8 for q in queries}
    sizes = spark.createDataFrame([(q, 12, 8, 5) for q in queries], "batch_ix int, n long, need long, need_fail long")
    closure = topology.closure(nodes)
    counts = T.node_counts(closure, lb)
    flat = {(q, x) for q, ps in queries.items() for x in leaves if sum(p in bits[x] for p in ps) >= need[q]}
    for kind, complete in (("simple", False), ("determined", False), ("determined,brief", True)):
        s = T.node_query_stats(qpos, sizes, counts, nodes, kind, complete)
        assert {(r.batch_ix, r.leaf) for r in T.matching_leaves(s, closure).collect()} == flat
    # the vectors of a determined tree, by definition
    under = {}
    for r in closure.collect():
        under.setdefault(r.node, []).append(bits[r.leaf])
    parent = {r[3]: rows[r[1]][3] if r[1] is not None else None for r in rows}
    want = set()
    for n, sets in under.items():
        cap, cup = set.intersection(*sets), set.union(*sets)
        up = under.get(parent[n])
        open_ = set(range(40)) if up is None else set.union(*up) - set.intersection(*up)
        want |= {(n, "det", p) for p in open_ if p in cap or p not in cup} | {(n, "how", p) for p in open_ & cap}
    got = {tuple(r) for r in T.determined_tree(T.active(spark, counts, nodes, closure, 40)).select("node", "vector", "pos").collect()}
    assert got == want
    assert T.union_differences(T.union_tree(counts), nodes).isEmpty()


def test_clustering_joins_the_closest_first(spark):
    packed = np.packbits(np.array([[1, 1, 0, 0, 0, 0, 0, 0], [1, 1, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 0, 0, 1, 1, 1, 0]], np.uint8), axis=1)
    assert C.agglomerate(packed) == [(0, 1), (2, 3), (4, 5)]
    rows = C.binary_tree(list("abcd"), C.agglomerate(packed))
    assert [r[2] for r in rows if r[3]] == list("abcd")
    forest = C.culled(rows, {rows[0][2]})
    assert [r[2] for r in forest] == [0, 1, 1, 0, 1, 1] and [r[3] for r in forest if not r[5]] == ["node1", "node2"]


def test_search_counts_repeats_and_thresholds(spark):
    q = spark.createDataFrame([(0, "q0", "ACGTACGTACGT", 0.7), (1, "none", "NN", 0.7), (2, "free", "TTTTTTTT", 0.0)], "batch_ix int, name string, seq string, threshold double")
    s = spark.createDataFrame([("x", "ACGTACGTAC"), ("y", "GGGGGGGGGG"), ("z", "AC")], "filter_id string, seq string")
    spec = FilterSpec(k=4, num_bits=1 << 20)
    f, b = FL.build(s, spec)
    m = {(r.name, r.filter_id): (r.hits, r.n) for r in S.search(q, f, b, spec).collect()}
    assert m == {("q0", "x"): (9, 9), ("free", "x"): (0, 5), ("free", "y"): (0, 5), ("free", "z"): (0, 5)}
    assert {r.name: r.n_matches for r in S.match_counts(q, S.search(q, f, b, spec)).collect()} == {"q0": 1, "none": 0, "free": 3}
    assert {r.filter_id: r.set_size for r in f.collect()} == {"x": 3, "y": 1, "z": 0}
    few = S.kmer_counts(q, spec, distinct=True).where("batch_ix = 0").first()
    assert few.n == 3
    assert FL.inconsistent(f.unionByName(FL.build(s, spec.like(k=5))[0])) == ["k"]
    with pytest.raises(ValueError):
        FilterSpec(k=4, num_bits=10, modulus=5)


def test_inspection_of_a_small_tree(spark):
    nodes = spark.createDataFrame(topology.parse(["r", "*a", "**b", "**c", "*d"]), topology.NODE_SCHEMA)
    st = {r.node: (r.depth, r.height, r.subtree, r.siblings, r.niblings, r.leaves) for r in I.node_stats(nodes, topology.closure(nodes)).collect()}
    assert st["r"] == (1, 3, 5, 0, 0, 3) and st["d"] == (2, 1, 1, 1, 2, 1) and st["b"] == (3, 1, 1, 1, 0, 1)
    v = spark.createDataFrame([("v", 0), ("v", 3)], "vec string, pos long")
    assert I.dump(v, ["vec"], 5).first().bits == "10010"
    assert I.checksum(v, ["vec"], 5).first().checksum == I.checksum(v, ["vec"], 8).first().checksum


def test_allsome_stats_leave_out_nodes_without_active_positions(spark):
    """All leaves agree on all bits: only the root has positions of its own."""
    nodes = spark.createDataFrame(topology.parse(["root", "*a", "*b"]), topology.NODE_SCHEMA)
    bits = spark.createDataFrame([(n, p) for n in "ab" for p in range(4)], "filter_id string, pos long")
    vectors = T.allsome_tree(T.node_counts(topology.closure(nodes), bits), nodes)
    assert [tuple(r) for r in I.allsome_stats(vectors, nodes, 4).collect()] == [("root", 4, 4, 0, 0)]

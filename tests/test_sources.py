import numpy as np
import pytest

from gramlode.operators import filters as FL
from gramlode.operators.kmers import FilterSpec
from gramlode.operators.search import search
from gramlode.sources import filters as SF
from gramlode.sources import results, sequences, topology
from gramlode.streaming.search import query_stream, search_stream, to_parquet


def test_query_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">q one\nACG\nTAC\n\n>\nGGGG\n>empty\n")
    (tmp_path / "b.txt").write_text("\nACGT\n\nTTTT\n")
    q = sequences.read_queries(spark, [f"{tmp_path}/a.fa=0.5", f"{tmp_path}/b.txt"], 0.9).orderBy("batch_ix").collect()
    assert [(r.name, r.seq, r.threshold) for r in q] == [("q one", "ACGTAC", 0.5), ("a5", "GGGG", 0.5), ("b.txt2", "ACGT", 0.9), ("b.txt4", "TTTT", 0.9)]
    with pytest.raises(ValueError):
        sequences.parse_queries("ACGT\n>late\n")


def test_reads_kmers_and_lists(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">x y\nAC\nGT\n>z\n\n>w\nTT\n")
    (tmp_path / "r.fq").write_text("@a\nACGT\n+\n@III\n@b\nGGCC\n+b\n+III\n")
    (tmp_path / "k.txt").write_text("ACGT 5\nNNNN\nacgt\n")
    (tmp_path / "l.txt").write_text("a.fa b.fa --out=x.bf\nc.kmers --kmersin\n")
    assert {(r.name, r.seq) for r in sequences.read_fasta(spark, f"{tmp_path}/r.fa").collect()} == {("x y", "ACGT"), ("w", "TT")}
    assert sorted(r.seq for r in sequences.read_fastq(spark, f"{tmp_path}/r.fq").collect()) == ["ACGT", "GGCC"]
    assert [r.mer for r in sequences.read_kmers(spark, f"{tmp_path}/k.txt", 4).collect()] == ["ACGT", "ACGT"]
    got = {r.out: (list(r.files), r.kmersin) for r in sequences.read_build_list(spark, f"{tmp_path}/l.txt").collect()}
    assert got == {"x.bf": (["a.fa", "b.fa"], False), "c.bf": (["c.kmers"], True)}


def test_topology_round_trip(spark, tmp_path):
    text = ["root.bf", "*child1.bf", "**child3[child4.bf]", "***child5.bf", "***child6[child5.bf]", "**child4.bf", "*child2[child1.bf]"]
    nodes = spark.createDataFrame(topology.parse(text), topology.NODE_SCHEMA)
    topology.write(nodes, f"{tmp_path}/t", "both")
    again = topology.parse([r.value for r in spark.read.text(f"{tmp_path}/t").collect()])
    assert [r[1:4] + (r[5],) for r in again] == [r[1:4] + (r[5],) for r in topology.parse(text)]
    assert {r.leaf for r in topology.closure(nodes).where("node = 'child3'").collect()} == {"child5", "child6"}
    with pytest.raises(ValueError):
        topology.parse(["a", "**b"])


def test_binary_and_parquet_filters(spark, tmp_path):
    props = {"kind": "determined", "k": 20, "num_hashes": 1, "seed1": 0, "seed2": 0, "modulus": 200, "num_bits": 130, "set_size": 3}
    (tmp_path / "x.det.bf").write_bytes(SF.build_file(props, [np.array([0, 63, 64, 129]), np.array([5])]))
    f, b = SF.import_binary(spark, f"{tmp_path}/x.det.bf")
    r = f.first()
    assert (r.filter_id, r.kind, r.modulus, r.set_size) == ("x", "determined", 200, 3)
    assert {(x.vector_ix, x.pos) for x in b.collect()} == {(0, 0), (0, 63), (0, 64), (0, 129), (1, 5)}
    SF.write(f, b, f"{tmp_path}/index")
    f2, b2 = SF.read(spark, f"{tmp_path}/index")
    assert f2.collect() == f.collect() and b2.count() == 5
    assert SF.combine([f2], [b2])[0].first().set_size is None
    with pytest.raises(ValueError):
        SF.combine([f2, f2], [b2, b2])


def test_result_texts(spark, tmp_path):
    q = spark.createDataFrame([(0, "a"), (1, "b")], "batch_ix int, name string")
    m = spark.createDataFrame([(0, "x", 1, 3, 4), (0, "y", 2, 3, 4)], "batch_ix int, leaf string, rank int, hits long, n long")
    lines = [r.line for r in results.lines(q, m, counts=True).orderBy("batch_ix", "line_ix").collect()]
    assert lines == ["*a 2", "x 3/4 0.750000", "y 3/4 0.750000", "*b 0"]
    (tmp_path / "log").write_text("*a 2\n# 7 nodes examined\nx\ny\n*b 0\n")
    got = {(r.query, r.hit, r.nodes_examined) for r in results.read(spark, f"{tmp_path}/log").collect()}
    assert got == {("a", "x", 7), ("a", "y", 7), ("b", None, None)}


def test_streamed_queries_give_the_batch_answer(spark, tmp_path):
    spec = FilterSpec(k=4, num_bits=1 << 16)
    f, b = FL.build(spark.createDataFrame([("x", "ACGTACGT"), ("y", "TTTTTTGG")], "filter_id string, seq string"), spec)
    q = spark.createDataFrame([(0, "p", "ACGTAC", 0.7), (1, "r", "TTTTTT", 0.7)], "batch_ix int, name string, seq string, threshold double")
    q.write.json(f"{tmp_path}/in")
    s = search_stream(query_stream(spark, f"{tmp_path}/in"), f, b, spec, to_parquet(f"{tmp_path}/out"), f"{tmp_path}/ck")
    s.awaitTermination()
    got = {(r.name, r.filter_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.name, r.filter_id) for r in search(q, f, b, spec).collect()} == {("p", "x"), ("r", "y")}

import random

import pytest
from pyspark.sql import functions as F

from gramlode.functions import hashing, numbers, rates, sequences
from gramlode.operators.kmers import FilterSpec, count_kmers, kmers, position_column, positions

VECTORS = {
    "TCAAGGCTAGAATACAGTGC": ("A8935862630222C7", "D5613DC6145BAEC2"),
    "ACGTACGTACGTACGTACGT": ("5EF220B381DFFB40", "051849FEDB471E8E"),
    "AAAAAAAAAAAAAAAAAAAA": ("6340E113E3EFB3A4", "006FA2B75966808F"),
    "ATGACCAGATATGTACTTGC": ("4C6C296C56CF3958", "3A05895F2524450C"),
}


def test_hash_vectors(spark):
    df = spark.createDataFrame([(m,) for m in VECTORS], "m string")
    rows = df.select("m", F.lpad(F.hex(hashing.hash_column(F.col("m"), 20)), 16, "0").alias("a"), F.lpad(F.hex(hashing.hash_column(F.lower("m"), 20, 1)), 16, "0").alias("b")).collect()
    for r in rows:
        assert (r.a, r.b) == VECTORS[r.m]
        assert hashing.hash_kmer(r.m) == int(r.a, 16) == int(hashing.hash_windows(r.m, 20)[1][0])


def test_hash_is_strand_neutral_and_skips_other_letters(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGTN") if rng.random() < 0.05 else rng.choice("ACGT") for _ in range(400))
    starts, h = hashing.hash_windows(seq, 11)
    for s, x in zip(starts.tolist(), h.tolist(), strict=True):
        m = seq[s : s + 11]
        rc = m[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert "N" not in m and x == hashing.hash_kmer(m) == hashing.hash_kmer(rc)
    assert hashing.hash_kmer("ACGN") is None
    u = rng.getrandbits(64)
    assert hashing.unstep(hashing.step(u)) == u == hashing.unmix(hashing.mix(u))


def test_positions_agree_with_the_expression_form(spark):
    df = spark.createDataFrame([(1, "ACGTTGCAACGTNACGTTTGCAC" * 3), (2, "AC"), (3, None), (4, "")], "id int, seq string")
    spec = FilterSpec(k=7, num_bits=500, modulus=900)
    got = sorted(tuple(r) for r in positions(df, spec).collect())
    want = kmers(df, 7).select("id", position_column(F.col("mer"), spec).alias("p")).where("p is not null")
    assert got and got == sorted(tuple(r) for r in want.collect())


def test_counts_merge_strands(spark):
    df = spark.createDataFrame([("a", "AAAC"), ("a", "GTTT"), ("a", "CCCC")], "filter_id string, mer string")
    assert {(r.mer, r.n) for r in count_kmers(df, ["filter_id"], least=2).collect()} == {("AAAC", 2)}


def test_numbers():
    assert [numbers.real(x) for x in ("0.3", "30%", "3/10")] == pytest.approx([0.3] * 3)
    assert [numbers.integer(x) for x in ("800K", "1.5M", "2g", "0x10", "7")] == [800_000, 1_500_000, 2_000_000_000, 16, 7]
    assert numbers.integer("1K", 1024) == 1024
    with pytest.raises(ValueError):
        numbers.probability("110%")


def test_sequences(spark):
    r = spark.range(1).select(
        sequences.reverse_complement(F.lit("ACGTN")).alias("rc"), sequences.filter_name(F.lit("/a/b/x1.detbrief.rrr.bf")).alias("name"),
        sequences.quoted_fields(F.lit('a "b c" d')).alias("q"), sequences.numbered(F.lit("f{number}.fa"), 2).alias("n"), sequences.strip_suffix(F.lit("x.bf"), ".bf").alias("s"),
    ).first()
    assert (r.rc, r.name, list(r.q), list(r.n), r.s) == ("NACGT", "x1", ["a", "b c", "d"], ["f1.fa", "f2.fa"], "x")


def test_sizes_and_rates(spark):
    row = spark.createDataFrame([(92_864, 600, 790, 94_638)], "items long, hits long, n long, size long")
    r = row.select(rates.filter_size(F.col("items"), 0.1).alias("s"), rates.needed(0.7, F.col("n")).alias("need"), rates.false_positive_rate(1, 322_500, F.col("size")).alias("fp")).first()
    assert r.s == 881_393 and r.need == 553
    # published adjusted hits of one leaf with 56,645 k-mers at the size that all published rows follow
    adj = spark.createDataFrame([(600, 790, 56_645)], "h long, n long, s long").select(rates.adjusted_hits(F.col("h"), F.col("n"), rates.false_positive_rate(1, 322_500, F.col("s"))).alias("a")).first()
    assert adj.a == 564
    assert rates.search_size(lambda b: b >= 5000) == 5000
    assert rates.query_false_positive_rate(100, 0.7, 0.7, 0.1) == 1.0


def test_checksum_of_bits():
    assert hashing.bit_checksum("") == 0
    assert hashing.bit_checksum("1") == hashing.bit_checksum("10000000")

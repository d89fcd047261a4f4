"""K-mers of sequences: text, positions and counts.

Text k-mers come from built-in expressions. Positions (hashes modulo a filter's modulus) are computed for whole
sequences in numpy, one Arrow batch at a time, as that is some fifty times less work than hashing k-mer strings; the
expression form in functions.hashing gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PACKED, hash_packed, hash_windows, more_hashes, packed_windows

#: Rows of an Arrow batch that leaves a task.
BATCH = 1 << 18


@dataclass(frozen=True)
class FilterSpec:
    """Parameters that filters must share to be compared. modulus: hash range, of which the first num_bits are kept."""

    k: int = 20
    num_bits: int = 500_000
    modulus: int | None = None
    num_hashes: int = 1
    seed1: int = 0
    seed2: int = 0
    canonical: bool = True

    def __post_init__(self) -> None:
        if self.k < 1 or self.num_hashes < 1 or self.num_bits < 2 or self.range < self.num_bits:
            raise ValueError("k and num_hashes are 1 or more, num_bits 2 or more, and the modulus num_bits or more")

    @property
    def range(self) -> int:
        return self.num_bits if self.modulus is None else self.modulus

    def like(self, **changes) -> FilterSpec:
        from dataclasses import replace

        return replace(self, **changes)


def kmer_texts(seq: Column, k: int) -> Column:
    """array<string>: all windows of k letters A, C, G, T, upper case, in order; repeats stay. One pass over the sequence."""
    return F.regexp_extract_all(F.upper(seq), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def kmers(sequences: DataFrame, k: int, seq: str = "seq", keep: list[str] | None = None) -> DataFrame:
    """keep, mer: one row for each occurrence. Other letters break runs; runs shorter than k have no rows."""
    keep = [c for c in sequences.columns if c != seq] if keep is None else keep
    return sequences.select(*keep, F.explode(kmer_texts(F.col(seq), k)).alias("mer"))


def canonical_text(mer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    from ..functions.sequences import reverse_complement

    return F.least(mer, reverse_complement(mer))


def count_kmers(mers: DataFrame, keys: list[str], canonical: bool = True, least: int = 1) -> DataFrame:
    """keys, mer, n: abundance; counts are combined before the shuffle. k-mers below the least abundance go."""
    m = mers.withColumn("mer", canonical_text(F.col("mer"))) if canonical else mers
    c = m.groupBy(*keys, "mer").agg(F.count("*").alias("n"))
    return c.where(F.col("n") >= least) if least > 1 else c


#: Windows of one key that a task counts at once.
WINDOWS = 1 << 21


def packed_counts(sequences: DataFrame, k: int, key: str, seq: str = "seq", canonical: bool = True, least: int = 1) -> DataFrame:
    """key, code, n: abundance of packed k-mers (k of 31 or fewer). Tasks count up to WINDOWS windows of a key at once, so
    that one row for each distinct k-mer, a pair of longs, is shuffled and combined."""
    if k > PACKED:
        raise ValueError(f"k-mers of more than {PACKED} letters are counted as text")
    rows = sequences.select(F.col(key), F.col(seq).alias("_seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        names = rows_names

        def flush(own) -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held.pop(own)[1]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([own] * len(codes), kind), pa.array(codes), pa.array(n)], names=names)

        for b in batches:
            kind = b.column(0).type
            for own, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                codes = packed_windows(s.as_py() or "", k, canonical)
                if len(codes):
                    kept = held.setdefault(own, [0, []])
                    kept[0] += len(codes)
                    kept[1].append(codes)
                    if kept[0] >= WINDOWS:
                        yield flush(own)
            while sum(n for n, _ in held.values()) > 2 * WINDOWS:
                yield flush(max(held, key=lambda x: held[x][0]))
        for own in list(held):
            yield flush(own)

    rows_names = [key, "code", "n"]
    found = rows.mapInArrow(run, rows.select(key).schema.add("code", "long").add("n", "long"))
    c = found.groupBy(key, "code").agg(F.sum("n").alias("n"))
    return c.where(F.col("n") >= least) if least > 1 else c


def packed_positions(codes: DataFrame, spec: FilterSpec, key: str) -> DataFrame:
    """key, pos of packed k-mers (key, code), those outside the filter left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.asarray(b.column(1), np.int64)
            h = [hash_packed(c, spec.k, spec.seed1, spec.canonical)]
            if spec.num_hashes > 1:
                h = more_hashes(h[0], hash_packed(c, spec.k, spec.seed2, spec.canonical), spec.num_hashes)
            pos = np.concatenate([x % np.uint64(spec.range) for x in h])
            rep = np.tile(np.arange(len(c)), len(h))[pos < np.uint64(spec.num_bits)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rep)), pa.array(pos[pos < np.uint64(spec.num_bits)].astype(np.int64))], names=[key, "pos"])

    return codes.select(key, "code").mapInArrow(run, codes.select(key).schema.add("pos", "long"))


def positions(sequences: DataFrame, spec: FilterSpec, seq: str = "seq", keep: list[str] | None = None, distinct_in_row: bool = False) -> DataFrame:
    """keep, pos: one row for each k-mer occurrence (or distinct position of a row) whose position lies in the filter.

    With several hashes a k-mer has several rows. Null sequences have none.
    """
    keep = [c for c in sequences.columns if c != seq] if keep is None else keep
    rows = sequences.select(*keep, F.col(seq).alias("_seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, at, n = [], [], 0

            def flush(held: list, at: list, b: pa.RecordBatch = b) -> pa.RecordBatch:
                rep = pa.array(np.repeat(np.array(at, np.int64), [len(h) for h in held]))
                return pa.RecordBatch.from_arrays([*(c.take(rep) for c in b.columns[:-1]), pa.array(np.concatenate(held).astype(np.int64))], names=[*b.schema.names[:-1], "pos"])

            for i, s in enumerate(b.column(b.num_columns - 1)):
                pos = sequence_positions(s.as_py() or "", spec)
                pos = np.unique(pos) if distinct_in_row else pos
                for lo in range(0, len(pos), BATCH):
                    held.append(pos[lo : lo + BATCH])
                    at.append(i)
                    n += len(held[-1])
                    if n >= BATCH:
                        yield flush(held, at)
                        held, at, n = [], [], 0
            if held:
                yield flush(held, at)

    schema = rows.select(*keep).schema.add("pos", "long")
    return rows.mapInArrow(run, schema)


def sequence_positions(seq: str, spec: FilterSpec) -> np.ndarray:
    """Positions of a sequence's k-mers in order, those outside the filter left out."""
    _, h = hash_windows(seq, spec.k, spec.seed1, spec.canonical)
    if spec.num_hashes > 1:
        _, h2 = hash_windows(seq, spec.k, spec.seed2, spec.canonical)
        h = np.stack(more_hashes(h, h2, spec.num_hashes), axis=1).reshape(-1)
    pos = h % np.uint64(spec.range)
    return pos[pos < np.uint64(spec.num_bits)]


def position_column(mer: Column, spec: FilterSpec) -> Column:
    """Position of a column of k-mers by built-in expressions (one hash); null where invalid or outside the filter."""
    from ..functions.hashing import hash_column, unsigned_mod

    p = unsigned_mod(hash_column(mer, spec.k, spec.seed1, spec.canonical), spec.range)
    return F.when(p < spec.num_bits, p)


def checksum(pos: DataFrame, keys: list[str]) -> DataFrame:
    """keys, checksum: 29 bits of the sum and exclusive or of positions, whatever their order."""
    return pos.groupBy(*keys).agg((F.sum(F.pmod("pos", F.lit(1 << 29))).bitwiseXOR(F.bit_xor("pos"))).bitwiseAND(F.lit((1 << 29) - 1).cast("long")).alias("checksum"))

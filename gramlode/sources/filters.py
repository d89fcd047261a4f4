"""Filters in Parquet, and an import of uncompressed binary filter files.

filters: filter_id, kind, k, num_hashes, seed1, seed2, modulus, num_bits, set_size (null: not known).
filter_bits: filter_id, vector_ix, pos, one row for each bit that is set.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_SCHEMA = "filter_id string, kind string, k int, num_hashes int, seed1 long, seed2 long, modulus long, num_bits long, set_size long"
BIT_SCHEMA = "filter_id string, vector_ix int, pos long"

# Fixed values of the binary format: magic, version, kinds and compressors; fields of the header and of each vector.
MAGIC, VERSION = 0xD532006662544253, 2
KIND_NAMES = {1: "simple", 2: "allsome", 3: "determined", 4: "determined,brief", 0xFFFFFF00: "intersection"}
COMPRESSORS = {1: "uncompressed", 2: "zeros", 3: "ones", 4: "rrr", 5: "roar", 6: "unc_rrr", 7: "unc_roar"}
HEADER = "<QIIIIIIQQQQIIQ"
#: Bits of an imported vector that leave a task in one batch.
CHUNK = 1 << 18
VECTOR = "<IIQQQ"


def write(filters: DataFrame, bits: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes both tables. Bits are ranged and sorted by position, so that row-group statistics prune by position."""
    filters.write.mode("overwrite").parquet(f"{path}/filters")
    dealt = bits.repartitionByRange(parts, "pos") if parts else bits.repartitionByRange("pos")
    dealt.sortWithinPartitions("pos", "filter_id").write.mode("overwrite").parquet(f"{path}/filter_bits")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/filters"), spark.read.parquet(f"{path}/filter_bits")


def write_by_group(bits: DataFrame, groups: DataFrame, path: str) -> None:
    """Bits of several filters together, one folder for each group (such as siblings). groups: filter_id, grp."""
    bits.join(groups, "filter_id").repartition("grp").sortWithinPartitions("pos").write.mode("overwrite").partitionBy("grp").parquet(path)


def combine(filters: list[DataFrame], bits: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One table of several; as in a combined file, set sizes are no longer known. A filter_id that occurs twice is an error."""
    f, b = filters[0], bits[0]
    for x, y in zip(filters[1:], bits[1:], strict=True):
        f, b = f.unionByName(x), b.unionByName(y)
    twice = f.groupBy("filter_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"filter {twice[0].filter_id} occurs twice")
    return f.withColumn("set_size", F.lit(None).cast("long")), b


def parse_header(data: bytes) -> tuple[dict, list[tuple[str, int, int]]]:
    """Properties and (compressor, offset, bytes) of each vector; checks what the format promises."""
    magic, size, version, kind, _, k, hashes, seed1, seed2, modulus, bits, vectors, known, items = struct.unpack_from(HEADER, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a finished filter file of version 2")
    if kind not in KIND_NAMES or hashes < 1 or bits < 2 or modulus < bits:
        raise ValueError("the header holds an impossible value")
    infos = []
    for v in range(vectors):
        c, _, offset, nbytes, _ = struct.unpack_from(VECTOR, data, struct.calcsize(HEADER) + v * struct.calcsize(VECTOR))
        infos.append((COMPRESSORS[c], offset, nbytes))
    if infos and infos[0][1] != size:
        raise ValueError("vectors do not follow the header")
    props = {"kind": KIND_NAMES[kind], "k": k, "num_hashes": hashes, "seed1": seed1, "seed2": seed2, "modulus": modulus, "num_bits": bits, "set_size": items if known else None}
    return props, infos


def header_lines(data: bytes) -> list[str]:
    """The properties and vectors of a binary file's header as text, one a line."""
    props, infos = parse_header(data)
    return [f"{k}: {'unknown' if x is None else x}" for k, x in props.items()] + [f"vector {i}: {c}, offset {o}, bytes {n}" for i, (c, o, n) in enumerate(infos)]


def build_file(props: dict, vectors: list[np.ndarray]) -> bytes:
    """A binary file of uncompressed vectors, given as arrays of set positions."""
    head = struct.calcsize(HEADER) + len(vectors) * struct.calcsize(VECTOR)
    kind = next(k for k, n in KIND_NAMES.items() if n == props["kind"])
    bodies = []
    for pos in vectors:
        flags = np.zeros(-(-props["num_bits"] // 64) * 64, np.uint8)
        flags[pos] = 1
        bodies.append(struct.pack("<Q", props["num_bits"]) + np.packbits(flags, bitorder="little").tobytes())
    known = props["set_size"] is not None
    out = struct.pack(HEADER, MAGIC, head, VERSION, kind, 0, props["k"], props["num_hashes"], props["seed1"], props["seed2"], props["modulus"], props["num_bits"], len(vectors), int(known), props["set_size"] or 0)
    at = head
    for b in bodies:
        out += struct.pack(VECTOR, 1, 0, at, len(b), 0)
        at += len(b)
    return out + b"".join(bodies)


def set_positions(data: bytes, num_bits: int, compressor: str, offset: int, nbytes: int) -> np.ndarray:
    """Set bits of one vector: constant, or little-endian words behind an eight-byte size."""
    if compressor == "zeros":
        return np.empty(0, np.int64)
    if compressor == "ones":
        return np.arange(num_bits)
    if compressor not in ("uncompressed", "unc_rrr", "unc_roar"):
        raise ValueError(f"{compressor} vectors cannot be imported")
    words = np.frombuffer(data[offset + 8 : offset + nbytes], np.uint8)
    return np.flatnonzero(np.unpackbits(words, bitorder="little")[:num_bits])


def import_binary(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """filters and filter_bits of uncompressed binary files, one task row a file."""
    from ..functions.sequences import filter_name

    files = spark.read.format("binaryFile").load(paths).select(filter_name(F.col("path")).alias("filter_id"), "content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                p, _ = parse_header(r["content"])
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                row = {"filter_id": r["filter_id"]} | p
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                p, infos = parse_header(r["content"])
                for v, (c, offset, nbytes) in enumerate(infos):
                    pos = set_positions(r["content"], p["num_bits"], c, offset, nbytes)
                    for k in range(0, len(pos), CHUNK):
                        part = pos[k : k + CHUNK]
                        name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int8)), pa.array([r["filter_id"]])).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([name, pa.array(np.full(len(part), v, np.int32)), pa.array(part, pa.int64())], names=["filter_id", "vector_ix", "pos"])

    return files.mapInArrow(heads, FILTER_SCHEMA), files.mapInArrow(ones, BIT_SCHEMA)

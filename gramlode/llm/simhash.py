"""SimHash near-copies by a hierarchical index in Gray order.

Fingerprints of 64 bits come from hashed shingles of three words. Distinct fingerprints are dealt to buckets by masked
bit patterns: of any three disjoint masks that cover all bits, two fingerprints that differ in two bits or fewer agree
under one, so each bucket can be searched alone and no link is lost. A bucket over the limit is split in the same way
on its remaining bits, until it fits; with so few bits left it always does, as its fingerprints are distinct.
Within a bucket the fingerprints are sorted by Gray rank, which puts similar ones together; runs of neighbours are
factored into nodes that hold the bits all members share, level upon level, and pairs of nodes whose shared bits
already differ too much are pruned as a whole. Of each bucket only a spanning star of every linked set leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, cut, join_hot, table, words
from .components import components

#: Most differing bits of a link, words of a shingle, fingerprints of a bucket that one task searches, children of a node.
DISTANCE, SHINGLE, LIMIT, FANOUT = 2, 3, 2048, 8
ALL = (1 << 64) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(docs: DataFrame, keep: list[str], text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """keep, h: XXH64 (seed 42) of the shingles of the text, A-Z lower-cased; a null text has none."""
    d = docs.select(*keep, words(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)).alias("_w"))
    gram = lambda w, i: F.xxhash64(F.concat_ws(" ", w, *[F.get("_w", i + k) for k in range(1, n)]))
    many = F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(0))), gram)
    few = F.when(F.size("_w") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.concat_ws(" ", "_w"))))
    return d.select(*keep, F.when(F.size("_w") >= n, many).otherwise(few).alias("h"))


def majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each list values[offsets[i]:offsets[i + 1]]: the bits set in over half of it, as uint64."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    sizes = np.diff(offsets)
    at, step = 0, 1 << 18
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        full = np.flatnonzero(sizes[at:to]) + at
        counts = np.zeros((len(full), 64), np.int64)
        lo, hi = int(offsets[at]), int(offsets[to])
        if to == at + 1 and len(full):  # one list, perhaps a very long one
            for k in range(lo, hi, step):
                counts[0] += np.unpackbits(values[k : min(k + step, hi)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        elif len(full):
            bits = np.unpackbits(values[lo:hi].view(np.uint8), bitorder="little").reshape(-1, 64)
            counts[:] = np.add.reduceat(bits, offsets[full] - lo, axis=0, dtype=np.int32)
        if len(full):
            out[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        at = to
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = b.column(b.num_columns - 1)
        flat = np.ascontiguousarray(h.values.to_numpy(zero_copy_only=False)).view(np.uint64)
        prints = majority(flat, np.asarray(h.offsets, np.int64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints)], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, fp (bigint, the 64 bits of the fingerprint); 0 for a text without words."""
    h = shingle_hashes(docs, keep, text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in h.schema.fields[:-1])
    return h.mapInArrow(_fingerprint_batches, f"{kinds}, fp bigint")


def thirds(mask: int, parts: int = DISTANCE + 1) -> list[int]:
    """The mask with one more of the given number of parts of its free bits fixed, for each part."""
    free = [b for b in range(64) if not mask >> b & 1]
    ends = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


def gray_rank(x: Column) -> Column:
    """Place of a bit pattern in the Gray code sequence, as a bigint that sorts in that order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(signed(1 << 63)).cast("long"))


def buckets(spark: SparkSession, rows: DataFrame, limit: int = LIMIT, distance: int = DISTANCE) -> DataFrame:
    """rows: fp and others (distinct). mask, pat and those: every row in each of its buckets; a bucket holds limit rows at
    most, or has few free bits or equal fingerprints."""
    own, masks, done = rows.columns, [0], []
    while True:
        split = [(signed(m), signed(c)) for m in masks for c in thirds(m, distance + 1)]
        if masks == [0]:
            rows = rows.select(*own, F.explode(F.array(*[F.lit(c).cast("long") for _, c in split])).alias("child"))
        else:
            step = F.broadcast(spark.createDataFrame(split, "mask long, child long"))  # some rows for each mask of this level
            rows = rows.join(step, "mask").select(*own, "child").distinct()
        masks = sorted({c for m in masks for c in thirds(m, distance + 1)})
        rows = rows.select(F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("pat"), *own)
        if 64 - min(m.bit_count() for m in masks) <= limit.bit_length() - 1:
            done.append(rows)
            break
        hot = cut(spark, rows.groupBy("mask", "pat").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where((F.col("n") > limit) & (F.col("lo") != F.col("hi"))).select("mask", "pat"))
        if hot.isEmpty():
            done.append(rows)
            break
        hot = checked(hot)
        done.append(rows.join(hot, ["mask", "pat"], "left_anti"))
        rows = cut(spark, rows.join(hot, ["mask", "pat"], "left_semi").select("mask", *own))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _index(fp: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the leaves up: shared mask, shared pattern and first child of each node; starts of buckets in fp."""
    levels = [(np.full(len(fp), ALL, np.uint64), fp, np.arange(len(fp) + 1))]
    while len(levels[-1][0]) > len(starts) - 1:
        mask, pat, _ = levels[-1]
        sizes = np.diff(starts)
        up = -(-sizes // FANOUT)
        first = np.repeat(starts[:-1], up) + FANOUT * (np.arange(up.sum()) - np.repeat(np.cumsum(up) - up, up))
        ones = np.bitwise_and.reduceat(pat & mask, first)
        zeros = np.bitwise_and.reduceat(~pat & mask, first)
        levels.append((ones | zeros, ones, np.append(first, len(pat))))
        starts = np.concatenate([[0], np.cumsum(up)])
    return levels


def _links(fp: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs within the buckets: pairs of nodes are expanded level by level and pruned as a whole."""
    levels = _index(fp, starts)
    a = b = np.arange(len(starts) - 1)
    for (mask, pat, _), (_, _, first) in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        n = na * nb
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(nb, n)
        x, y = np.repeat(first[a], n) + at // wide, np.repeat(first[b], n) + at % wide
        live = (x <= y) & (np.bitwise_count((pat[x] ^ pat[y]) & mask[x] & mask[y]) <= distance)
        a, b = x[live], y[live]
    return a[a != b], b[a != b]


def _stars(fp: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each linked set within a bucket its members but the first, and the first."""
    a, b = _links(fp, starts, distance)
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    members = np.flatnonzero(label != np.arange(len(fp)))
    return fp[members], fp[label[members]]


def _search(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            starts = np.concatenate([[0], new, [rows.shape[1]]])
            sizes = np.diff(starts)
            many = np.flatnonzero(sizes > 1)
            work = np.cumsum(sizes[many] ** 2)
            for k in range(0, int(work[-1]) // (1 << 22) + 1 if len(many) else 0):  # so many pairs at a time
                part = many[(work - 1) // (1 << 22) == k]
                if len(part):
                    pick = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part])
                    u, v = _stars(rows[2][pick].view(np.uint64), np.concatenate([[0], np.cumsum(sizes[part])]), distance)
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            held = np.concatenate([held, np.array([np.asarray(c, np.int64) for c in b.columns[:3]])], axis=1)
            if held.shape[1]:
                last = int(np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1]))[-1]) + 1 if (held[:2] != held[:2, -1:]).any() else 0
                if last:
                    yield from flush(held[:, :last])
                    held = held[:, last:]
        if held.shape[1]:
            yield from flush(held)

    return run


def links(spark: SparkSession, distinct: DataFrame, distance: int = DISTANCE, limit: int = LIMIT) -> DataFrame:
    """u, v: links between distinct fingerprints, enough of them to connect all that the full set of links connects."""
    b = buckets(spark, distinct.select("fp"), limit, distance)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    b = b.repartition(parts, "mask", "pat").withColumn("_g", gray_rank(F.col("fp"))).sortWithinPartitions("mask", "pat", "_g")
    return b.select("mask", "pat", "fp").mapInArrow(_search(distance), "u bigint, v bigint")


def _named(spark: SparkSession, f: DataFrame) -> DataFrame:
    """f: doc_id, fp and further columns. f with root and component_id."""
    distinct = cut(spark, f.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(spark, links(spark, distinct.select("fp")))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    named = cut(spark, named)
    lows = cut(spark, named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("k")))
    whole = cut(spark, join_hot(named, lows, "root", "k").select("fp", "root", "component_id", "n"))
    return join_hot(f, whole, "fp", "n")


def near_copies(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs: doc_id and text (others are ignored). For each row: doc_id, fp, root, component_id.

    root names the component; component_id is its smallest doc_id. A null or empty text has fingerprint 0, and all
    such rows are one component with whatever lies near 0. A null doc_id is never the smallest; a component of nulls
    alone has a null component_id. Repeated rows stay; an empty table gives none.
    """
    f = cut(spark, fingerprints(docs, ["doc_id"], text_col))
    return _named(spark, f).select("doc_id", "fp", "root", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = near_copies(spark, table(spark, sf_dir, "documents"))
    return n.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Tree topologies by greedy agglomeration of leaf vectors, and culling of nodes that decide little.

Merging is inherently one after another; it runs on the driver over a sampled interval of positions, one packed row a
leaf (12.5 KB at the default interval), so thousands of filters need tens of megabytes whatever the data's size. The
leaf vectors are extracted and packed by Spark.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import to_buckets
from .tree import parents

#: Bits of a packed bitmap.
BUCKET = 32_768

#: Positions that are compared, and standard deviations below the mean at which a node is culled.
BITS, CULL_SD = 100_000, 2.0


def leaf_vectors(bits: DataFrame, start: int = 0, end: int = BITS) -> tuple[list[str], np.ndarray]:
    """Names in order and packed bits of all leaves within the interval, which starts at a multiple of 8."""
    if start % 8:
        raise ValueError("the interval starts at a multiple of 8")
    inside = bits.where((F.col("pos") >= start) & (F.col("pos") < end)).select(F.col("filter_id").alias("vec"), (F.col("pos") - start).alias("pos"))
    names = sorted(r.filter_id for r in bits.select("filter_id").distinct().collect())  # one row a filter
    place = {n: i for i, n in enumerate(names)}
    flat = np.zeros((len(names), -(-(end - start) // BUCKET) * BUCKET // 8), np.uint8)
    for r in to_buckets(inside).collect():  # packed by Spark: one bit a position
        at = (r.bucket - 1) * BUCKET // 8
        flat[place[r.vec], at : at + BUCKET // 8] = np.frombuffer(r.bitmap, np.uint8)
    return names, flat  # the order of bits within a byte does not matter to distances and unions


def agglomerate(packed: np.ndarray) -> list[tuple[int, int]]:
    """Merges (u, v) in order; merge i makes node n + i, the union of both. The closest pair goes first; of equally
    close ones the lower tree, then the smaller u and v."""
    n = len(packed)
    if n < 2:
        raise ValueError("a tree needs two leaves")
    rows, height, alive = list(packed), [0] * n, set(range(n))
    heap: list[tuple[int, int, int, int]] = []

    def offer(v: int, others: list[int]) -> None:
        if others:
            d = np.bitwise_count(np.stack([rows[u] for u in others]) ^ rows[v]).sum(1)
            for u, x in zip(others, d.tolist(), strict=True):
                heapq.heappush(heap, (x, 1 + max(height[u], height[v]), u, v))

    for v in range(1, n):
        offer(v, list(range(v)))
    merges = []
    while len(alive) > 1:
        _, h, u, v = heapq.heappop(heap)
        if u in alive and v in alive:
            alive -= {u, v}
            merges.append((u, v))
            rows.append(rows[u] | rows[v])
            height.append(h)
            offer(len(rows) - 1, sorted(alive))
            alive.add(len(rows) - 1)
            rows[u] = rows[v] = None
    return merges


def binary_tree(names: list[str], merges: list[tuple[int, int]], prefix: str = "node") -> list[tuple[int, int | None, str, bool]]:
    """(node, parent, name, is_leaf) of the merged tree, the root first, each node before its children."""
    n, kids = len(names), {len(names) + i: m for i, m in enumerate(merges)}
    out, stack = [], [(n + len(merges) - 1, None)]
    while stack:
        x, parent = stack.pop()
        me = len(out)
        out.append((me, parent, names[x] if x < n else f"{prefix}{n + len(merges) - x}", x < n))
        stack += [(c, me) for c in reversed(kids.get(x, ()))]
    return out


def determined_ratios(counts: DataFrame, nodes: DataFrame, num_bits: int) -> DataFrame:
    """node, n_det, n_informative: positions newly determined at a node, of those its parent leaves open; a root has all.

    counts: node, pos, c, n_leaves of tree.node_counts, within the interval of num_bits positions.
    """
    open_ = counts.groupBy("node").agg(F.count(F.when(F.col("c") < F.col("n_leaves"), 1)).alias("open"))
    p = parents(nodes).join(open_, "node", "left").fillna(0, ["open"])
    up = open_.select(F.col("node").alias("parent"), F.col("open").alias("above"))
    r = p.join(up, "parent", "left")
    n = F.when(F.col("parent").isNull(), F.lit(num_bits)).otherwise(F.coalesce("above", F.lit(0)))
    return r.select("node", (n - F.col("open")).cast("long").alias("n_det"), n.cast("long").alias("n_informative"))


def cull_threshold(ratios: DataFrame, nodes: DataFrame, sd: float = CULL_SD) -> DataFrame:
    """One row, threshold: mean less sd population deviations of the ratios of inner nodes, between 0 and 1."""
    inner = ratios.join(nodes.where("not is_leaf").select(F.col("name").alias("node")), "node").where("n_informative > 0")
    x = F.col("n_det") / F.col("n_informative")
    return inner.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(x) - sd * F.stddev_pop(x))).alias("threshold"))


def fruitless(ratios: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Names of the inner nodes that determine less than the threshold."""
    inner = nodes.where("not is_leaf").select(F.col("name").alias("node"))
    return ratios.join(inner, "node").where(F.col("n_det") < F.col("n_informative") * threshold).select("node")


def culled(nodes: list[tuple[int, int | None, str, bool]], gone: set[str], renumber: bool = True, prefix: str = "node") -> list[tuple[int, int | None, int, str, str, bool, list[str]]]:
    """Rows of a topology without the culled nodes; their children go to the nearest ancestor that stays.

    Without its root a tree becomes a forest. Inner nodes that stay are numbered from 1 by depth, then left to right.
    """
    keep, new_parent, depth = [], {}, {}
    for me, parent, name, leaf in nodes:  # parents come before children
        while parent is not None and parent in new_parent and nodes[parent][2] in gone:
            parent = new_parent[parent]
        new_parent[me] = parent
        if leaf or name not in gone:
            keep.append(me)
            depth[me] = 0 if parent is None else depth[parent] + 1
    names = {me: nodes[me][2] for me in keep}
    if renumber:
        inner = sorted((depth[m], i) for i, m in enumerate(keep) if not nodes[m][3])
        names |= {keep[i]: f"{prefix}{k}" for k, (_, i) in enumerate(inner, 1)}
    place = {m: i for i, m in enumerate(keep)}
    return [(place[m], None if new_parent[m] is None else place[new_parent[m]], depth[m], names[m], f"{names[m]}.bf", nodes[m][3], []) for m in keep]


def cluster(bits: DataFrame, start: int = 0, end: int = BITS, cull_sd: float | None = CULL_SD, cull: float | None = None, renumber: bool = True) -> DataFrame:
    """Topology (NODE_SCHEMA) of the leaves in bits (filter_id, pos), culled by deviations, by a threshold, or not."""
    from ..sources.topology import NODE_SCHEMA, closure
    from .tree import node_counts

    spark = bits.sparkSession
    names, packed = leaf_vectors(bits, start, end)
    rows = binary_tree(names, agglomerate(packed))
    gone: set[str] = set()
    if cull is not None or cull_sd is not None:
        nodes = spark.createDataFrame([(m, p, n, leaf) for m, p, n, leaf in rows], "node_ix int, parent_ix int, name string, is_leaf boolean")
        seen = node_counts(closure(nodes), bits.where((F.col("pos") >= start) & (F.col("pos") < end)))
        ratios = determined_ratios(seen, nodes, end - start)
        least = cull if cull is not None else cull_threshold(ratios, nodes, cull_sd).first().threshold
        gone = {r.node for r in fruitless(ratios, nodes, least).collect()} if least is not None else set()
    return spark.createDataFrame(culled(rows, gone, renumber), NODE_SCHEMA)


def depth_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count("*").alias("n"))

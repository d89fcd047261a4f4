"""Filter trees from leaf bits and a closure of (node, leaf).

Every vector of every node follows from c, the leaves under it that have a bit, and L, the leaves under it: one
grouping gives whole trees, without visiting nodes. A position is active at a node if its parent's leaves disagree on
it (at a root: always); inactive positions are inherited and not stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import ordinals

# Lookup results.
ABSENT, PRESENT, UNRESOLVED = 0, 1, -1


def leaf_totals(closure: DataFrame) -> DataFrame:
    return closure.groupBy("node").agg(F.count("*").alias("n_leaves"))


def node_counts(closure: DataFrame, bits: DataFrame) -> DataFrame:
    """node, pos, c, n_leaves for the positions that some leaf under the node has. bits: filter_id, pos."""
    b = bits.select(F.col("filter_id").alias("leaf"), "pos")
    c = b.join(closure, "leaf").groupBy("node", "pos").agg(F.count("*").alias("c"))
    return c.join(leaf_totals(closure), "node")


def union_tree(counts: DataFrame) -> DataFrame:
    return counts.select("node", "pos")


def intersection_tree(counts: DataFrame) -> DataFrame:
    return counts.where("c = n_leaves").select("node", "pos")


def parents(nodes: DataFrame) -> DataFrame:
    """node, parent (null for roots); names."""
    p = nodes.select(F.col("node_ix").alias("parent_ix"), F.col("name").alias("parent"))
    return nodes.select(F.col("name").alias("node"), "parent_ix").join(p, "parent_ix", "left").select("node", "parent")


def allsome_tree(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, vector (all or some), pos: shared by all leaves and not already so at the parent; set in some but not all."""
    cap = intersection_tree(counts)
    above = cap.select(F.col("node").alias("parent"), "pos")
    own = cap.join(parents(nodes), "node").join(above, ["parent", "pos"], "left_anti")
    some = counts.where("c < n_leaves")
    return own.select("node", F.lit("all").alias("vector"), "pos").unionByName(some.select("node", F.lit("some").alias("vector"), "pos"))


def active(spark: SparkSession, counts: DataFrame, nodes: DataFrame, closure: DataFrame, num_bits: int) -> DataFrame:
    """node, pos, c, n_leaves of all active positions; c 0 where no leaf under the node has the bit."""
    p = parents(nodes)
    undecided = counts.where("c < n_leaves").select(F.col("node").alias("parent"), "pos")
    below = p.where("parent is not null").join(undecided, "parent").select("node", "pos")
    roots = p.where("parent is null").select("node").join(spark.range(num_bits).withColumnRenamed("id", "pos"))
    have = counts.select("node", "pos", "c")
    return below.unionByName(roots).join(have, ["node", "pos"], "left").fillna(0, ["c"]).join(leaf_totals(closure), "node")


def determined_tree(act: DataFrame) -> DataFrame:
    """node, vector (det or how), pos: active positions on which all leaves agree; those among them that all have."""
    det = act.where("c = n_leaves or c = 0")
    return det.select("node", F.lit("det").alias("vector"), "pos").unionByName(det.where("c = n_leaves").select("node", F.lit("how").alias("vector"), "pos"))


def brief_tree(act: DataFrame) -> DataFrame:
    """node, vector, pos: as determined, with inactive positions squeezed out: det is numbered by active positions,
    how by the positions set in det."""
    d = ordinals(act, ["node"]).where("c = n_leaves or c = 0")
    h = ordinals(d.select("node", "pos", "c", "n_leaves"), ["node"]).where("c = n_leaves")
    return d.select("node", F.lit("det").alias("vector"), F.col("ord").alias("pos")).unionByName(h.select("node", F.lit("how").alias("vector"), F.col("ord").alias("pos")))


def brief_lengths(act: DataFrame) -> DataFrame:
    """node, det_length, how_length of the squeezed vectors."""
    return act.groupBy("node").agg(F.count("*").alias("det_length"), F.count(F.when((F.col("c") == F.col("n_leaves")) | (F.col("c") == 0), 1)).alias("how_length"))


def lookup(counts: DataFrame, asked: DataFrame, kind: str, nodes: DataFrame) -> DataFrame:
    """asked: node, pos. Adds state: absent 0, present 1, unresolved -1, as a node of the kind tells by itself and what
    was resolved above it; at a leaf unresolved is read as present."""
    leaf = nodes.select(F.col("name").alias("node"), "is_leaf")
    j = asked.join(counts, ["node", "pos"], "left").join(leaf, "node")
    none, every = F.coalesce("c", F.lit(0)) == 0, F.col("c") == F.col("n_leaves")
    if kind == "simple":
        state = F.when(none, ABSENT).otherwise(F.when(F.col("is_leaf"), PRESENT).otherwise(UNRESOLVED))
    elif kind in ("allsome", "determined", "determined,brief"):
        state = F.when(none, ABSENT).when(every, PRESENT).otherwise(UNRESOLVED)
    else:
        raise ValueError(f"no lookup in {kind} trees")
    return j.select("node", "pos", state.alias("state"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """node, ancestor: proper ancestors by name. One row a filter and level; walked on the driver."""
    up = {r.node_ix: (r.parent_ix, r.name) for r in nodes.select("node_ix", "parent_ix", "name").collect()}
    rows = []
    for parent, name in up.values():
        while parent is not None:
            parent, above = up[parent]
            rows.append((name, above))
    return nodes.sparkSession.createDataFrame(rows, "node string, ancestor string")


def node_query_stats(qpos: DataFrame, sizes: DataFrame, counts: DataFrame, nodes: DataFrame, kind: str = "determined", complete: bool = True) -> DataFrame:
    """batch_ix, node, examined, passed, failed, n_pass, n_fail, n_unresolved, local_pass, local_fail for every query with
    k-mers and node.

    Local counts are those that the node's parent leaves unresolved and the node resolves. Other counts are those of all positions of the query against the node's leaves. A node is examined if no proper ancestor
    has passed or failed. Simple trees do not pass above leaves; in complete mode no tree does.
    """
    hits = qpos.withColumnRenamed("c", "c_q").join(counts, "pos").groupBy("batch_ix", "node").agg(F.sum("c_q").alias("some"), F.sum(F.when(F.col("c") == F.col("n_leaves"), F.col("c_q")).otherwise(0)).alias("n_pass"))
    pairs = sizes.where("n > 0").join(nodes.select(F.col("name").alias("node"), "is_leaf"))
    j = pairs.join(hits, ["batch_ix", "node"], "left").fillna(0, ["some", "n_pass"])
    early = F.col("is_leaf") if complete or kind == "simple" else F.lit(True)
    j = j.withColumns({
        "n_fail": F.col("n") - F.col("some"), "n_unresolved": F.col("some") - F.col("n_pass"),
        "passed": early & (F.col("n_pass") >= F.col("need")), "failed": (F.col("n") - F.col("some")) >= F.col("need_fail"),
    })
    decided = j.where("passed or failed").select("batch_ix", F.col("node").alias("ancestor"))
    hidden = ancestors(nodes).join(decided, "ancestor").select("batch_ix", "node").distinct().withColumn("_hidden", F.lit(True))
    j = j.join(hidden, ["batch_ix", "node"], "left").withColumn("examined", F.col("_hidden").isNull())
    above = j.join(parents(nodes).where("parent is not null"), "node").select("batch_ix", "node", "parent")
    above = above.join(j.select("batch_ix", F.col("node").alias("parent"), F.col("n_pass").alias("_pass"), F.col("n_fail").alias("_fail")), ["batch_ix", "parent"]).drop("parent")
    j = j.join(above, ["batch_ix", "node"], "left").fillna(0, ["_pass", "_fail"])
    return j.select(
        "batch_ix", "node", "examined", (F.col("examined") & F.col("passed")).alias("passed"), (F.col("examined") & F.col("failed")).alias("failed"),
        "n_pass", "n_fail", "n_unresolved", (F.col("n_pass") - F.col("_pass")).alias("local_pass"), (F.col("n_fail") - F.col("_fail")).alias("local_fail"),
    )


def nodes_examined(stats: DataFrame) -> DataFrame:
    return stats.where("examined").groupBy("batch_ix").agg(F.count("*").alias("nodes_examined"))


def matching_leaves(stats: DataFrame, closure: DataFrame) -> DataFrame:
    """batch_ix, leaf: every leaf at or under an examined node that passed."""
    return stats.where("passed").select("batch_ix", "node").join(closure, "node").select("batch_ix", "leaf").distinct()


def only_children(nodes: DataFrame) -> DataFrame:
    """Names of the nodes without a sibling; a tree that is built has none."""
    n = nodes.where("parent_ix is not null").groupBy("parent_ix").agg(F.count("*").alias("c"), F.first("name").alias("name"))
    return n.where("c = 1").select("name")


def invalid_names(nodes: DataFrame, filters: DataFrame) -> DataFrame:
    """name, problem: nodes without a filter, filters without a node, and repeated node names."""
    names, ids = nodes.select("name"), filters.select(F.col("filter_id").alias("name"))
    twice = names.groupBy("name").count().where("count > 1").select("name", F.lit("repeated").alias("problem"))
    lost = names.join(ids, "name", "left_anti").select("name", F.lit("no filter").alias("problem"))
    return twice.unionByName(lost).unionByName(ids.join(names, "name", "left_anti").select("name", F.lit("no node").alias("problem")))


def union_differences(node_bits: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, pos in which an inner node differs from the union of its children; empty for a valid union tree."""
    p = parents(nodes).where("parent is not null")
    want = node_bits.join(p, "node").select(F.col("parent").alias("node"), "pos").distinct()
    inner = p.select(F.col("parent").alias("node")).distinct()
    have = node_bits.select("node", "pos").join(inner, "node", "left_semi").distinct()
    return want.exceptAll(have).unionByName(have.exceptAll(want))


def output_name(topology: str, kind: str, compression: str = "") -> str:
    """Name of the topology of a built tree: in.kind[.compression].sbt; the brief kind is written detbrief."""
    stem = topology.removesuffix(".sbt")
    short = {"simple": "", "allsome": ".allsome", "determined": ".det", "determined,brief": ".detbrief", "intersection": ".cap"}[kind]
    return f"{stem}{short}{'.' + compression if compression else ''}.sbt"

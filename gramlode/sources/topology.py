"""Topology files: a tree in pre-order, one node a line, depth written as asterisks.

A topology has one line for each filter, so it is small whatever the collection's size; it is parsed on the driver and
handed on as a DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "node_ix int, parent_ix int, depth int, name string, file string, is_leaf boolean, tags array<string>"


def parse(lines: Iterable[str], folder: str = "") -> list[tuple]:
    """Rows of NODE_SCHEMA. A level that is deeper by more than one is an error. Roots have depth 0 and no parent.

    A line is *..name, *..name[file], or either with further columns (tags) behind it.
    """
    rows: list[list] = []
    path: list[int] = []
    for number, line in enumerate(lines, 1):
        words = line.split()
        if not words:
            continue
        m = re.fullmatch(r"(\**)([^\[\]*]+)(?:\[([^\[\]]+)\])?", words[0])
        if not m:
            raise ValueError(f"line {number}: {line!r} is not a node")
        depth = len(m[1])
        if depth > len(path):
            raise ValueError(f"line {number}: depth {depth} follows depth {len(path) - 1}")
        del path[depth:]
        own = lambda f: f if not folder or f.startswith("/") else f"{folder}/{f}"
        name = re.sub(r"(\.(allsome|detbrief|det))?(\.(rrr|roar))?(\.unity)?(\.bf)?$", "", m[2].rsplit("/", 1)[-1])
        if path:
            rows[path[-1]][5] = False
        rows.append([len(rows), path[-1] if path else None, depth, name, own(m[3] or m[2]), True, words[1:]])
        path.append(len(rows) - 1)
    names = [r[3] for r in rows]
    if len(set(names)) != len(names):
        raise ValueError("a node name occurs twice")
    return [tuple(r) for r in rows]


def read(spark: SparkSession, path: str, only_leaves: bool = False) -> DataFrame:
    """Nodes of a topology file; file names are taken relative to the topology's folder."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    text = spark.read.text(path, wholetext=True).first()
    nodes = spark.createDataFrame(parse((text.value if text else "").split("\n"), folder), NODE_SCHEMA)
    return nodes.where("is_leaf") if only_leaves else nodes


def closure(nodes: DataFrame) -> DataFrame:
    """node, leaf: every node with each leaf at or under it; name columns, from node_ix, parent_ix, name, is_leaf."""
    up = {r.node_ix: (r.parent_ix, r.name, r.is_leaf) for r in nodes.select("node_ix", "parent_ix", "name", "is_leaf").collect()}  # one row a filter
    rows = []
    for _ix, (parent, name, leaf) in up.items():
        if leaf:
            rows.append((name, name))
            while parent is not None:
                parent, above, _ = up[parent]
                rows.append((above, name))
    return nodes.sparkSession.createDataFrame(rows, "node string, leaf string")


def post_order(nodes: DataFrame) -> DataFrame:
    """nodes with post_ix: their places where children come before their parents, from 0."""
    from pyspark.sql import Window as W

    # a node follows the nodes under it; those before it in pre-order that are no ancestors come first either way
    size = closure(nodes.withColumn("is_leaf", F.lit(True))).groupBy("node").agg(F.count("*").alias("_under"))
    sized = nodes.join(size, F.col("name") == F.col("node")).drop("node")
    return sized.withColumn("post_ix", F.row_number().over(W.orderBy(F.col("node_ix") + F.col("_under"), F.col("depth").desc())) - 1).drop("_under")


def children(nodes: DataFrame, name: str) -> DataFrame:
    """The children of a node, in order."""
    top = nodes.where(F.col("name") == name).select(F.col("node_ix").alias("_top"))
    return nodes.join(F.broadcast(top), F.col("parent_ix") == F.col("_top"), "left_semi").orderBy("node_ix")  # one row


def leaves(nodes: DataFrame) -> DataFrame:
    """The leaves in order."""
    return nodes.where("is_leaf").orderBy("node_ix")


def lines(nodes: DataFrame, style: str = "file") -> DataFrame:
    """node_ix, line: the topology text in pre-order. style: name, file, or both as name[file]."""
    text = {"name": F.col("name"), "file": F.col("file"), "both": F.concat("name", F.lit("["), "file", F.lit("]"))}[style]
    return nodes.select("node_ix", F.concat(F.repeat(F.lit("*"), F.col("depth")), text).alias("line"))


def write(nodes: DataFrame, path: str, style: str = "file") -> None:
    """One text file; a topology is small."""
    lines(nodes, style).coalesce(1).sortWithinPartitions("node_ix").select("line").write.mode("overwrite").text(path)

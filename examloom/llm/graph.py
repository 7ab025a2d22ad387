"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches. Nodes are longs.

    Each round points a node at the smallest of its neighbours and itself, follows these pointers to their ends, in steps
    of twice the length, and keeps of the edges only those between different ends. So edges inside what is known to be one
    component are read once; rounds are written to the shared folder and end when no edge is left.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(_components(edges, a, b), "components")


def _ends(pairs: DataFrame) -> DataFrame:
    """(node, root): where the pointers of each node end."""
    both = pairs.select(F.col("u").alias("node"), F.col("v").alias("other"))
    both = both.unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("other")))
    labels = both.groupBy("node").agg(F.min("other").alias("root"))
    labels = materialize(labels.select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        now = materialize(labels.join(jump, "root").select("node", "root", "far"), "labels")
        if now.where("far != root").isEmpty():
            return labels
        labels = now.select("node", F.col("far").alias("root"))


def _different(edges: DataFrame, a: str, b: str) -> DataFrame:
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    return materialize(pairs, "edges")


def _components(edges: DataFrame, a: str, b: str) -> DataFrame:
    pairs, out = _different(edges, a, b), None
    while True:
        ends = _ends(pairs)
        if out is None:
            out = ends
        else:
            on = out.join(ends.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
            out = materialize(on.select("node", F.coalesce("far", "root").alias("root")), "names")
        pairs = pairs.join(ends.select(F.col("node").alias("u"), F.col("root").alias("x")), "u")
        pairs = pairs.join(ends.select(F.col("node").alias("v"), F.col("root").alias("y")), "v")
        pairs = _different(pairs, "x", "y")
        if pairs.isEmpty():
            return out

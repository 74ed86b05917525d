"""Connected components by contraction: every round each node moves to the neighbour of smallest hash, edges follow, and
edges inside a node vanish. The expected number of nodes falls by a constant factor a round whatever the shape of the graph,
a hub never meets its neighbours in one task (its choice is a partial aggregate), and nothing goes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteflow.llm.common import settle


def _order(node: str, step: int) -> Column:
    return F.struct(F.xxhash64(F.lit(step), F.col(node)).alias("h"), F.col(node).alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) longs -> (node, root): every node that has an edge to another one, and a node that names its component.

    Self-links, repeated and reversed edges change nothing; rows with a null end are no edges; no edges give no rows."""
    current = settle(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    steps: list[DataFrame] = []
    while not current.isEmpty():
        step = len(steps)
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        best = both.groupBy("src").agg(F.min(_order("dst", step)).alias("best"))
        moved = settle(best.select(F.col("src").alias("node"), F.least(F.col("best"), _order("src", step))["v"].alias("root")))
        steps.append(moved)
        ends = current.join(moved.select(F.col("node").alias("src"), F.col("root").alias("a")), "src")
        ends = ends.join(moved.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst").where("a <> b")
        current = settle(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    if not steps:
        return current.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    found = steps.pop()
    while steps:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = steps.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return settle(found)

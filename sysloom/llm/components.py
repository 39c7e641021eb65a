"""Connected components of a link table, by contracting it round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node of each component) of every node of ``links``.

    Each round sends every node to the smallest of itself and its neighbours and joins nodes sent to one place,
    so a star needs one round and a chain of n a number of rounds that grows as the logarithm of n. Only counts
    reach the driver; each round's tables are written to the shared folder, and deleted once the next round's are there. Links with nulls and loops are left out.
    """
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col("a") < F.col("b")).distinct()
    edges = written(edges, "edges")
    nodes = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "nodes")
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        to = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("old"), F.least("a", "least").alias("new")), "contraction")
        old = [to, nodes, edges]
        nodes = written(nodes.join(to, nodes.component == to.old, "left").select("node", F.coalesce("new", "component").alias("component")), "nodes")
        edges = edges.join(to, edges.a == to.old).select(F.col("new").alias("a"), "b")
        edges = edges.join(to, edges.b == to.old).select("a", F.col("new").alias("b"))
        edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(*old)
    discard(edges)
    return nodes

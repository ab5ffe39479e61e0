"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node id reachable, for every node of an
    edge.  Self-loops and repeated edges are harmless; an edge with a null end
    is ignored.  Only aggregates with map-side combine and equi-joins run, so a
    hub with any number of edges stays divisible; labels never reach the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
    nodes_from = e = materialize(e, "edges")
    while True:
        # Large-star: a node's larger neighbours go to its smallest neighbour or itself.
        pairs = e.where("u <> v")
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low2")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(low, large, low2, *([] if e is nodes_from else [e]))
        e = new
        # Done when no node that points on is pointed at: the edges are stars.
        if e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    nodes = nodes_from.select(F.col("u").alias("node")).unionByName(nodes_from.select(F.col("v").alias("node"))).distinct()
    nodes = materialize(nodes, "nodes")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    out = materialize(nodes.join(roots, "node", "left").select("node", F.coalesce("m", "node").alias("component")), "components")
    discard(nodes, e, nodes_from)
    return out

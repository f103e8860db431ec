"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label for each node that an edge names; two nodes have one label if edges connect them.

    Each round gives every node its smallest neighbour (or itself) as parent and contracts the graph along the parents,
    until no edge is left. A round is a few hash aggregations and joins over tables in the shared folder; parents are
    found by partial aggregation, so a node with many edges is no hot spot there. Self-edges and repeated edges are
    allowed; an empty graph gives no rows."""
    graph = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).where("node is not null").distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    while not graph.isEmpty():
        both = graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("old"), F.least("a", "b").alias("new")), "parents")
        labels = materialize(labels.join(parents, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
        left = parents.select(F.col("old").alias("a"), F.col("new").alias("na"))
        right = parents.select(F.col("old").alias("b"), F.col("new").alias("nb"))
        moved = graph.join(left, "a").join(right, "b").where("na <> nb")
        graph = materialize(moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "edges")
    return labels

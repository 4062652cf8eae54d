"""Connected components of the nodes that edges name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.operators import graph

from .common import materialise


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node
    reachable.  Null ends and loops are ignored; an empty list gives an empty result."""
    pairs = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    pairs = materialise(pairs.select(F.col(u).alias("src"), F.col(v).alias("dst")))
    nodes = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    return graph.components(nodes, pairs).select(F.col("id").alias("node"), F.col("comp").alias("root"))

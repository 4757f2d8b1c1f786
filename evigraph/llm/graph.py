"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed


def _jump(parent: DataFrame) -> DataFrame:
    """Point every node at the root of its tree by pointer doubling."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        parent = checkpointed(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        moved = parent.where("moved").limit(1).count()
        parent = parent.select("node", "root")
        if not moved:
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (longs).

    ``root`` is the smallest node of the component. In each round every node
    takes its smallest neighbour as parent, the trees are flattened by pointer
    doubling and contracted to their roots; a round at least halves the nodes
    that still have links. Links are reduced by minimum, which partial sums
    do before the shuffle, and joined by node or root with tables that have one
    row for each; of a root with very many nodes, adaptive execution splits the
    large side of the join, which is a checkpoint and so a plain shuffle. Each
    step is a checkpoint. Self links and repeated links change nothing; links with a null
    end are ignored.
    """
    ordered = lambda e: e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = checkpointed(ordered(edges))
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        parent = _jump(lowest.select("node", F.least("node", "root").alias("root")))
        if labels is None:
            labels = parent
        else:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = checkpointed(labels.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        of_u = parent.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        of_v = parent.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = checkpointed(ordered(edges.join(of_u, "u").join(of_v, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))))
        if not edges.limit(1).count():
            return labels

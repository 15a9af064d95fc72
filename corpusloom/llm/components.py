"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import discard, stash

#: Nodes up to which their labels (some tens of bytes each) are broadcast; beyond, joins shuffle both sides.
BROADCAST_NODES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node of its component.

    Each round takes the smallest label of a node's neighbours and then that label's own label, so stars end in two
    rounds and chains in about a logarithm of their length. A round's labels are a written table; only the number of
    changed labels comes to the driver. Self-loops and repeated edges do no harm; no edges give no rows.
    """
    edges = stash(edges.where("a <> b").select("a", "b").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    labels = held = stash(first.select("node", F.least("node", "root").alias("root")), "labels")
    side = F.broadcast if labels.count() <= BROADCAST_NODES else lambda df: df
    while True:
        near = (
            both.join(side(labels.select(F.col("node").alias("b"), "root")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lower = near.join(side(labels), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = side(labels.select(F.col("node").alias("root"), F.col("root").alias("next")))
        new = lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = stash(new, "labels")
        discard(held)
        held = new
        changed = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            discard(edges)
            return side(labels)

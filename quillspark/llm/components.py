"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``component`` (least node of its component) for the nodes of edges (``a``, ``b``: long), as a
    table of :func:`saved`.

    Each round finds the least label among a node's neighbours, offers it to the node and to the node's own label, and then
    takes the label of the label; so whole trees hook on to each other and rounds grow with the logarithm of the longest
    path. Labels are written each round, in the shared folder, and those of the round before are deleted; only a count
    reaches the driver. Before the join by label they are written as well, so that both sides are plain shuffles and a label
    that many nodes have can be split.
    """
    edges = edges.filter("a <> b")
    # Both directions come from one row: edges computed twice might differ, as between equal sets any may stand for all.
    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(edges.select(F.explode(turned).alias("e")).select("e.a", "e.b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component").hint("merge"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")).join(labels.hint("merge"), "node")
        offers = F.explode(F.array(F.struct("node", "near"), F.struct(F.col("component").alias("node"), "near"))).alias("o")
        offers = near.select(offers).groupBy("o.node").agg(F.min("o.near").alias("near"))
        nearer = saved(labels.join(offers.hint("merge"), "node").select("node", "component", F.least("component", "near").alias("to")))
        jump = nearer.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        new = nearer.join(jump.hint("merge"), "to")
        new = saved(new.select("node", F.least("to", "beyond").alias("component"), (F.col("component") > F.least("to", "beyond")).alias("moved")))
        discard(labels, nearer)
        labels = new
        if not new.filter("moved").limit(1).count():
            discard(both)
            out = labels.select("node", "component")
            out.saved_path = labels.saved_path
            return out
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

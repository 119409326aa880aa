"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def components(scratch: Scratch, links: DataFrame, tag: str) -> DataFrame:
    """``links`` (a, b): long ids. Returns (node, component): the smallest id that can be reached, for every id in
    a link. Each round hooks each root onto its smallest neighbour, shortens the chains by pointer jumping and
    contracts the links, so rounds grow with the logarithm of the longest path. Self links and repeats are allowed;
    no links give no rows."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = scratch.table(both.where("a <> b").distinct(), f"{tag}-left0")
    labels, turn = None, 0
    while not left.isEmpty():
        hook = left.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hook = scratch.table(hook, f"{tag}-hook{turn}-0")
        jump = 0
        while True:  # chains end at roots that stay
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jump += 1
            hook = scratch.table(hook.join(up, "root").select("node", F.col("top").alias("root"),
                                                              (F.col("top") != F.col("root")).alias("moved")),
                                 f"{tag}-hook{turn}-{jump}")
            moved = not hook.where("moved").isEmpty()
            hook = hook.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = hook.select("node", F.col("root").alias("component"))
        else:
            up = hook.select(F.col("node").alias("component"), "root")
            labels = scratch.table(labels.join(up, "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")), f"{tag}-labels{turn}")
        turn += 1
        root_a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        root_b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = scratch.table(left.join(root_a, "a").join(root_b, "b").where("ra <> rb")
                             .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), f"{tag}-left{turn}")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels

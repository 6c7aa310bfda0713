"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowworth.llm.keeping import Keeper
from rowworth.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(a, b)`; component is the smallest node reachable.

    Each round points every node at its smallest neighbour's smallest neighbour and relabels the
    links, which at least halves the nodes that have links; a star is done in one round. Links
    and labels are written out, so no plan grows and no task holds a component. Links of a node
    with itself and links with a null end count as no link; no links give no rows.
    """
    keeper = Keeper(edges.sparkSession)
    links = keeper.keep(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not links.isEmpty():
        sides = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = sides.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        step = keeper.keep(step.select("node", F.least("node", "up").alias("up")))
        # one jump: the parent's parent
        further = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = keeper.keep(step.join(further, "up").select("node", "top"))
        moved = jump.withColumnRenamed("node", "component")
        labels = keeper.keep(
            labels.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        )
        ends = links.join(jump.select(F.col("node").alias("a"), F.col("top").alias("x")), "a")
        ends = ends.join(jump.select(F.col("node").alias("b"), F.col("top").alias("y")), "b")
        links = keeper.keep(
            ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    labels = settle(labels)
    keeper.clear()
    return labels

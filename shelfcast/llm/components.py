"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import written_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); component: smallest node reachable.

    Each round every node points to its smallest neighbour, pointers are jumped once, and the edges are redrawn
    between what they point to; loops and repeats go. The edges left shrink by a factor each round, so a chain
    takes about log n rounds. Only aggregates with partial sums and joins of narrow rows, so a node with very
    many edges is no group in memory. Null ends are ignored.
    """
    live = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    live = written_table(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    live = live.filter("a <> b")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        least = least.select("node", F.least("node", "up").alias("up"))
        above = least.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = written_table(least.join(above, "up").select("node", F.col("top").alias("up")))
        up = parent.select(F.col("node").alias("component"), "up")
        labels = labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        for end in ("a", "b"):
            live = live.join(parent.select(F.col("node").alias(end), "up"), end).drop(end).withColumnRenamed("up", end)
        live = live.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        live = written_table(live.distinct())
    # Pointers lead to smaller nodes only, and the smallest node of a component never moves.
    return written_table(labels)

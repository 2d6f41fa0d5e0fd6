"""Connected components of a table of links, without leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node in ``links`` (a, b: long).

    Every node takes the smallest label among its own and its neighbours', and then its label's
    label, until nothing changes; the second step halves the distance to the smallest node, so
    long chains need few rounds.  A node with very many links costs one row a task, as minima are
    taken before rows are shuffled.
    """
    tables = Tables(links.sparkSession)
    both = tables.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = tables.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        now = labels.select("node", "component")
        near = both.join(now, both.b == now.node).groupBy("a").agg(F.min("component").alias("m"))
        taken = now.join(near, now.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        up = now.select(F.col("node").alias("new"), F.col("component").alias("above"))
        moved = taken.join(up, "new", "left").select("node", "old", F.least("new", "above").alias("component"))
        moved = tables.written(moved, "labels")
        tables.drop(labels)
        labels = moved
        if moved.where(F.col("old") != F.col("component")).isEmpty():
            tables.drop(both)
            return moved.select("node", "component")

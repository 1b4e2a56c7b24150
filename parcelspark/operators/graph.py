"""Connected components by minimum labels, each round checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.stages import settled


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of nodes (id) under links (a, b): the smallest id that can be reached. Labels jump to their label's label, so chains shorten by halves."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settled(both)
    labels = settled(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        after = settled(step.join(jump, "next", "left").select("id", F.coalesce("far", "next").alias("component"), "was"))
        if after.filter("component <> was").isEmpty():
            return after.select("id", "component")
        labels = after.select("id", "component")

"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook every neighbour (large: greater ones; small: smaller ones and the node) to the least node nearby.

    Written as joins with per-node minima, so a node with many neighbours is never gathered.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        return both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a <> b").distinct()
    down = both.filter("b < a")
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    return down.join(low, "a").select(F.col("low").alias("x"), F.col("b").alias("y")).filter("x <> y").unionByName(low.select(F.col("low").alias("x"), F.col("a").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(doc, label) for every end of a link (a, b); label is the least id of its component. A table made by :func:`materialise`."""
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    before = None
    while True:
        after = materialise(_star(_star(edges, True), False), "edges")
        discard(edges)
        edges = after
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            break
        before = now
    stars = edges.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("label"))
    tops = edges.select(F.col("a").alias("doc"), F.col("a").alias("label")).distinct().join(stars.select("doc"), "doc", "left_anti")
    labels = materialise(stars.unionByName(tops), "labels")
    discard(edges)
    return labels

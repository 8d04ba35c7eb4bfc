"""Connected components by alternating stars: edges shrink to one star per component, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each node on the least of them and the node: its larger ones (and itself), or its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge and is not the least of its component, with that least node. `edges` is read twice."""
    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = mark(edges)
    while True:
        stars = stored(_star(_star(edges, True), False), "edges")
        forget(edges)
        edges, now = stars, mark(stars)
        if now == was:
            return edges
        was = now

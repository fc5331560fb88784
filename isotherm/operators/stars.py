"""Connected components of a table of links, by alternating stars: joins and minima, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.shared import clear, mark, materialize


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that links reach) of every node of links (a long, b long).

    Each round ties every node's larger neighbours, then its smaller ones, to the smallest of them. Neighbours'
    minima are aggregated before the shuffle, written, and joined back, so that a node with many links is no hot group:
    adaptive execution splits it.
    The rounds, whose number grows with the logarithm of the longest path, are cut by tables in the shared folder.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = edges.union(edges.select("b", "a")).toDF("u", "v")
            least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
            out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
            out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.where("a <> b").distinct()

    edges = links.select("a", "b").where("a <> b")
    before, begun = None, mark()
    while True:
        edges = materialize(star(star(edges, True), False), "stars")
        clear(links.sparkSession, begun, keep=1)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

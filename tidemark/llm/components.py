"""Connected components by large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges but the roots: root is the smallest node reachable.

    Large star: a node hands the smallest node it knows to its larger neighbours. Small star: to its smaller
    neighbours and itself. Both are an aggregate for the smallest neighbour - partial sums, so a node with any number
    of neighbours is no hot group - and a join that adaptive execution splits where a node is hot. The rounds, about as many as
    the logarithm of the longest path, end when the links no longer change; each is written to the shared folder.
    """
    links = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links")
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now

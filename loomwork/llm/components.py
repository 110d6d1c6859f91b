"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root) for every node that isn't its component's smallest.

    Alternates two steps until nothing changes: each node hands its larger neighbours the smallest it knows,
    then its smaller ones. Both need only a minimum for each node, which is aggregated before the shuffle, so a
    node with very many neighbours does no harm. The rounds grow with the logarithm of the number of nodes.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, staged(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(last, large)
        if (new := _mark(now)) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))")).first())

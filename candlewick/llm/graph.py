"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges (a, b)``.

    Alternating stars: each node points its larger neighbours at the smallest
    one, then its smaller ones. A round is two aggregations and joins on nodes;
    the rounds grow with the logarithm of the longest path. Each round is
    written to the shared folder, so a lost executor costs one round at most.
    Edges with a null end and loops are ignored.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select(
            "n", F.least("n", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        now = stored(
            large.join(small, F.col("u") == F.col("n")).where("v <> m").select(
                F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), name)

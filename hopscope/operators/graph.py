"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge joins to another; component is the smallest node reachable.

    Alternates large-star and small-star rounds, which reach one star per component in a number of
    rounds that grows with the logarithm of the nodes. Each round is one checkpointed table of at most
    as many edges as the last, and nothing but two numbers reaches the driver. Edges with a null end
    and loops are left out.
    """
    now = (
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") != F.col("hi")))
        .distinct()
        .checkpoint()
    )
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x")).first()
        if seen == mark:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        mark = seen
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(down, "hi").filter("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        now = moved.union(down.select(F.col("m").alias("lo"), "hi")).distinct().checkpoint()

"""Connected components of an edge table, without the driver ever seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node with an edge in ``edges`` (a long, b long); root is the smallest node reachable.

    Alternating large-star and small-star steps: each step links every node to
    the smallest node in its neighbourhood and never grows the edge count, so
    long chains shrink geometrically. Every round is cut by a checkpoint.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        # large star: each node hands its larger neighbours to the smallest of its neighbourhood
        both = links.select(F.col("v").alias("n"), F.col("u").alias("m")).union(links.select(F.col("u").alias("n"), F.col("v").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("low"))
        large = both.join(low, "n").filter("m > n").select(F.col("m").alias("v"), F.least("low", "n").alias("u")).filter("u <> v").distinct()
        # small star: each node hands its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("low").alias("u")).union(low.select("v", F.col("low").alias("u"))).filter("u <> v").distinct()
        links = cut(small)
        after = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0))).first()
        if after == before:
            return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table

MOST_ROUNDS = 60


def _star(links: DataFrame) -> DataFrame:
    """(u, v) and the least of u and its neighbours v. The least is combined before it is shuffled, so hubs are no burden."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("mu")).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node of its component. Nodes are longs."""
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = Table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        sums = now.df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(sums) == mark or sums[0] == 0:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(sums)
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = Table(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        now.drop()
        small = _star(large.df)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v")
        now = Table(small.distinct(), "small-star")
        large.drop()
    raise RuntimeError(f"the components did not settle in {MOST_ROUNDS} rounds")

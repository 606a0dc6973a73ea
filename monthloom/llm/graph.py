"""Connected components of an edge table, by alternating star contraction; nothing is gathered on the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, joined

MAX_ROUNDS = 60
#: Edges that one task takes; a table of no more needs no exchange.
ONE_TASK = 20_000


def components(edges: DataFrame) -> DataFrame:
    """id, component for every id that occurs in edges (a long, b long); component is the smallest id reachable."""
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = signature(now)
    for _ in range(MAX_ROUNDS):
        if not last[0]:
            break
        few = last[0] <= ONE_TASK
        tight = (lambda df: df.coalesce(1)) if few else (lambda df: df)
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = tight(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        star = both.join(low, "u") if few else joined(both, low.select("u", "m"), "u", ["v"], counts=low)
        large = star.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = tight(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
        before, now = now, cut(small.where(F.col("u") != F.col("v")).distinct())
        discard(before)
        if (this := signature(now)) == last:
            break
        last = this
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return roots.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

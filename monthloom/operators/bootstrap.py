"""Cluster bootstrap by hashed draws: the same clusters are drawn in every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_draws(pairs: DataFrame, cluster: str, a: Column, b: Column, draws: int, seed: str = "boot") -> DataFrame:
    """draw, difference: for each draw of as many clusters as there are, with return, the difference of mean a and mean b.

    Rows are first summed up by cluster; what is drawn and joined is a number for each draw and cluster.
    """
    sums = pairs.groupBy(cluster).agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.count(F.lit(1)).alias("n"))
    numbered = sums.withColumn("at", (F.row_number().over(Window.orderBy(cluster)) - 1).cast("long"))
    size = sums.agg(F.count(F.lit(1)).alias("size"))  # one row
    numbers = pairs.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))  # dealt over tasks
    drawn = numbers.join(F.broadcast(size)).where("size > 0").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("int"))))
    key = F.md5(F.concat(F.lit(seed + ":"), F.col("draw").cast("string"), F.lit(":"), F.col("k").cast("string")).cast("binary"))
    drawn = drawn.withColumn("at", F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.col("size"))
    return drawn.join(numbered, "at").groupBy("draw").agg(((F.sum("a") - F.sum("b")) / F.sum("n")).alias("difference"))


def interval(drawn: DataFrame, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return drawn.agg(F.percentile("difference", F.lit(tail)).alias("low"), F.percentile("difference", F.lit(1 - tail)).alias("high"))

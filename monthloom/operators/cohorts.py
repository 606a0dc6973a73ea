"""Cohorts of territories by hash order, coverage and spread, and their set relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_rank_key
from .panel import SERIES, by_series


def eligible(panel: DataFrame, categories: int, observed: int = 9) -> DataFrame:
    """Territories with enough observations in the first twelve months of every category; later months don't matter."""
    per = panel.where("t < 12").groupBy(*SERIES).agg(F.count("y").alias("n"))
    return per.groupBy("territory_id").agg(F.bool_and(F.col("n") >= observed).alias("ok"), F.count(F.lit(1)).alias("k")).where((F.col("k") == categories) & F.col("ok")).select("territory_id")


def hash_ranked(territories: DataFrame, seed: str) -> DataFrame:
    """territory_id, place from 1 in the order of a seeded digest; one row a territory, which is a small dimension."""
    return territories.withColumn("place", F.row_number().over(Window.orderBy(hash_rank_key(seed, F.col("territory_id")), "territory_id")))


def hash_cohort(panel: DataFrame, seed: str, size: int, categories: int, excluded: DataFrame | None = None) -> DataFrame:
    pool = eligible(panel, categories)
    if excluded is not None:
        pool = pool.join(excluded.select("territory_id"), "territory_id", "left_anti")
    return hash_ranked(pool, seed).where(F.col("place") <= size)


def spread_cohort(panel: DataFrame, category: str, size: int, months: int) -> DataFrame:
    """Complete series at evenly spaced places of the order by first-year mean: place floor((i + .5) * n / size)."""
    whole = panel.where(F.col("category") == category).withColumn("n", F.count("y").over(by_series())).where(F.col("n") >= months)
    means = whole.where("t < 12").groupBy("territory_id").agg(F.avg("y").alias("m"))
    ranked = means.withColumn("at", F.row_number().over(Window.orderBy("m", "territory_id")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    spots = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.floor((i + 0.5) * F.col("n") / size))
    return ranked.where(F.array_contains(spots, F.col("at").cast("long"))).select("territory_id", "at")


def latest_version(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

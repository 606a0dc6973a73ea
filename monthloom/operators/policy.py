"""Choosing models by group from errors, and applying the choice; blends; conformal intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_model(pairs: DataFrame, *groups: str) -> DataFrame:
    """The model with the least mean error; a tie goes by name."""
    e = pairs.groupBy(*groups, "model").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    return e.groupBy(*groups).agg(F.min(F.struct("mae", "model")).alias("best")).select(*groups, F.col("best.model").alias("model"), F.col("best.mae").alias("mae"))


def gated_policy(pairs: DataFrame, base: str, order: list[str], gain: float = 0.98, groups: tuple[str, ...] = ("h", "category"), fixed: tuple[int, ...] = (12,)) -> DataFrame:
    """The best model if its error is at most `gain` of the base's, else the base; a tie goes by the list's order. Fixed horizons keep the base."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    e = pairs.groupBy(*groups, "model").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    picked = e.groupBy(*groups).agg(F.min(F.struct(F.col("mae"), place.alias("place"), F.col("model"))).alias("best"), F.max(F.when(F.col("model") == base, F.col("mae"))).alias("base_mae"))
    ok = F.col("best.mae") <= gain * F.col("base_mae")
    if "h" in groups and fixed:
        ok = ok & ~F.col("h").isin(*fixed)
    return picked.select(*groups, F.when(ok, F.col("best.model")).otherwise(base).alias("model"), F.col("best.mae").alias("best_mae"), "base_mae")


def applied(pairs: DataFrame, policy: DataFrame, groups: tuple[str, ...] = ("h", "category")) -> DataFrame:
    """The rows of each group's chosen model; the policy has a row for each group."""
    return pairs.join(policy.select(*groups, "model"), [*groups, "model"])


def blend(a: str, b: str, weight: float) -> Column:
    return F.lit(weight) * F.col(a) + F.lit(1 - weight) * F.col(b)


def order_statistic(scores: DataFrame, score: str, coverage: float, *groups: str) -> DataFrame:
    """The ceil((n + 1) * coverage)-th smallest score of each group as q; fails where that is beyond n.

    By ranks rather than by a gathered array, so that a group is not held by one task's memory.
    """
    w = Window.partitionBy(*groups)
    ranked = scores.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(score)))
    k = F.ceil((F.col("__n") + 1) * F.lit(float(coverage)))
    short = F.raise_error(F.lit("too few scores for the coverage"))
    return ranked.where((F.col("__r") == k) | ((k > F.col("__n")) & (F.col("__r") == 1))).select(*groups, F.when(k > F.col("__n"), short.cast("double")).otherwise(F.col(score)).alias("q"))


def conformal(tuned: DataFrame, pairs: DataFrame, coverage: float = 0.9, groups: tuple[str, ...] = ("h", "category")) -> DataFrame:
    """lower, upper around predicted: the scaled error's largest value by territory gives one score each, by group. Fails on a group of too few territories."""
    score = F.abs(F.col("predicted") - F.col("actual")) / F.col("history_scale")
    per = tuned.groupBy(*groups, "territory_id").agg(F.max(score).alias("score"))
    q = order_statistic(per, "score", coverage, *groups)
    out = pairs.join(F.broadcast(q), [*groups])  # a row for each horizon and category
    return out.withColumn("lower", F.greatest(F.col("predicted") - F.col("q") * F.col("history_scale"), F.lit(0.0))).withColumn("upper", F.col("predicted") + F.col("q") * F.col("history_scale"))

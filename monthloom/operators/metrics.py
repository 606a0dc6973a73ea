"""Errors by group, paired comparisons, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tidy


def error_aggregates() -> list[Column]:
    """n, mae, wape, r2, mean scaled error of rows with actual, predicted, history_scale."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    sse, sst = F.sum(F.pow(F.col("predicted") - F.col("actual"), 2)), F.var_pop("actual") * F.count("actual")
    return [
        F.count(F.lit(1)).alias("n"), tidy(F.avg(e)).alias("mae"), tidy(F.sum(e) / F.nullif(F.sum(F.abs("actual")), F.lit(0.0)), 6).alias("wape"),
        tidy(F.when(F.count("actual") > 1, 1 - sse / F.nullif(sst, F.lit(0.0))), 6).alias("r2"), tidy(F.avg(e / F.col("history_scale")), 6).alias("scaled_error"),
    ]


def by_group(pairs: DataFrame, *groups: str) -> DataFrame:
    return pairs.groupBy(*groups).agg(*error_aggregates())


def by_scope(pairs: DataFrame) -> DataFrame:
    """Each row counts for the scope 'all', and those of the total category for 'total' too; origin -1 is all origins."""
    scopes = pairs.withColumn("scope", F.explode(F.when(F.col("category") == "ALL", F.array(F.lit("all"), F.lit("total"))).otherwise(F.array(F.lit("all")))))
    both = scopes.withColumn("origin", F.explode(F.array("c", F.lit(-1))))
    return both.groupBy("model", "scope", "origin").agg(F.countDistinct("c").alias("origins"), *error_aggregates()[:2])


def coverage(intervals: DataFrame, *groups: str) -> DataFrame:
    """Share of pairs and of whole series within [lower, upper], and the mean width."""
    inside = intervals.withColumn("inside", F.col("actual").between(F.col("lower"), F.col("upper")))
    series = inside.groupBy(*groups, "territory_id", "category").agg(F.bool_and("inside").alias("joint"), F.count(F.lit(1)).alias("n"), F.sum(F.col("inside").cast("int")).alias("k"), F.sum(F.col("upper") - F.col("lower")).alias("width"))
    return series.groupBy(*groups).agg(F.sum("n").alias("n"), tidy(F.sum("k") / F.sum("n"), 6).alias("coverage"), tidy(F.avg(F.col("joint").cast("int")), 6).alias("joint_coverage"), tidy(F.sum("width") / F.sum("n")).alias("mean_width"))


def paired_change(pairs: DataFrame, model: str, base: str, *groups: str) -> DataFrame:
    """Mean errors of two model columns on the same pairs, and the change in percent."""
    mae = {m: F.avg(F.abs(F.col(m) - F.col("actual"))) for m in (model, base)}
    out = pairs.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), mae[model].alias("a"), mae[base].alias("b"))
    return out.select(*groups, "n", tidy("a").alias("mae_model"), tidy("b").alias("mae_base"), tidy((F.col("a") / F.nullif(F.col("b"), F.lit(0.0)) - 1) * 100).alias("change_pct"))


def win_share(pairs: DataFrame, model: str, base: str, *groups: str) -> DataFrame:
    """Share of territories where the model's own mean error is below the base's."""
    own = pairs.groupBy(*groups, "territory_id").agg(F.avg(F.abs(F.col(model) - F.col("actual"))).alias("a"), F.avg(F.abs(F.col(base) - F.col("actual"))).alias("b"))
    return own.groupBy(*groups).agg(F.count(F.lit(1)).alias("territories"), tidy(F.avg((F.col("a") < F.col("b")).cast("int")), 6).alias("win_share"))

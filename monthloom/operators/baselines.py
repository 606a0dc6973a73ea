"""Baseline forecasts from the observed months before an origin: last value, seasonal, damped trend, scaled seasonal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import SERIES

MODELS = ["last_value", "seasonal_naive", "damped_trend", "seasonal_scaled"]
#: origin (months known) and horizon
CASES = [(12, 1), (12, 3), (12, 6), (12, 12), (15, 1), (15, 3), (15, 6), (18, 1), (18, 3), (18, 6), (21, 1), (21, 3), (23, 1)]


def baselines(panel: DataFrame, cases: list[tuple[int, int]] = CASES) -> DataFrame:
    """territory_id, category, c, h, target, history_scale and a column for each model; one pass over the prefixes.

    Nothing at or after c is read. The ratio to the month twelve before comes from a self join on the month, as months
    can be absent.
    """
    before = panel.select(*SERIES, (F.col("t") + 12).alias("t"), F.col("y").alias("y12"))
    rows = panel.join(before, [*SERIES, "t"], "left").withColumn("ratio", F.when(F.col("y12") > 0, F.col("y") / F.col("y12")))
    by_origin: dict[int, list[int]] = {}
    for c, h in cases:
        by_origin.setdefault(c, []).append(h)
    known = rows.withColumn("c", F.explode(F.array(*map(F.lit, by_origin)))).where("t < c")
    recent = F.row_number().over(Window.partitionBy(*SERIES, "c").orderBy(F.desc("t"))) <= 6
    known = known.withColumn("recent", recent)
    per_origin = known.groupBy(*SERIES, "c").agg(
        F.max_by("y", "t").alias("last"), F.max("t").alias("t_last"), F.expr("regr_slope(y, t) FILTER (WHERE recent)").alias("slope"), F.count("y").alias("n"),
        F.percentile("ratio", F.lit(0.5)).alias("ratio"), F.greatest(F.avg(F.abs("y")), F.lit(1.0)).alias("history_scale"), F.map_from_entries(F.collect_list(F.struct("t", "y"))).alias("seen"),
    )
    horizons = F.create_map(*[x for c, hs in by_origin.items() for x in (F.lit(c), F.array(*map(F.lit, hs)))])
    out = per_origin.withColumn("h", F.explode(horizons[F.col("c")])).withColumn("target", F.col("c") + F.col("h") - 1)
    # a key of the prefix's map is below c, so a month at or after c is never found
    out = out.withColumn("seasonal", F.coalesce(F.try_element_at("seen", F.col("target") - 12), F.col("last")))
    steps = (1 - F.pow(F.lit(0.8), F.col("target") - F.col("t_last"))) * 4
    floor = lambda x: F.greatest(x, F.lit(0.0))
    return out.select(
        *SERIES, "c", "h", "target", "history_scale", floor(F.col("last")).alias("last_value"), floor(F.col("seasonal")).alias("seasonal_naive"),
        floor(F.col("last") + F.when(F.col("n") > 1, F.coalesce("slope", F.lit(0.0))).otherwise(0.0) * steps).alias("damped_trend"), floor(F.col("seasonal") * F.coalesce("ratio", F.lit(1.0))).alias("seasonal_scaled"),
    )


def with_actual(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """Pairs with an observed target; a missing target drops the pair for all models alike."""
    return forecasts.join(panel.select(*SERIES, F.col("t").alias("target"), F.col("y").alias("actual")), [*SERIES, "target"])


def long(wide: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """A row for each model: model, predicted."""
    keep = [c for c in wide.columns if c not in models]
    return wide.unpivot(keep, models, "model", "predicted")


def split_label(c: str = "c", h: str = "h", target: str = "target"):
    return F.when(F.col(h) == 12, "diagnostic").when(F.col(target) <= 17, "validation").when(F.col(c) >= 18, "test").otherwise("bridge")

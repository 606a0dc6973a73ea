"""The chain of forecasts: blends chosen by policy (v2), panel mixes chosen against them (v3), a gated online mix of factor
members (v4), and the correction by national levels (v5). Each step takes pairs and adds a column; policies have a row for
each horizon and category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .factors import growth, decomposed, by_category, at_month
from .panel import SERIES, dense_prefixes, filled_forward
from .policy import blend, gated_policy

KEYS = [*SERIES, "c", "h"]
WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
V2_NAMES = [*(f"blend_{int(100 * w)}" for w in WEIGHTS), "adapted", "adapted_mix"]
V3_NAMES = ["v2", *(f"panel_k{k}_w{w}" for k in (3, 6) for w in (25, 75)), "v2_panel_k3", "v2_panel_k6"]
MIXED = ["pooled_growth", "shrink_growth", "factor_state", "factor_damped"]


def adapted_last(panel: DataFrame, cases: list[tuple[int, int]]) -> DataFrame:
    """adapted: the last value with the first year's season taken out before and put back for the target's month.

    The season is the first twelve logs less their line, centred; the result stays within a quarter and four times the last
    value. The same as adapters.season_adapted around the registered forecaster `last`, as column functions.
    """
    cases = [(c, h) for c, h in cases if c >= 12]
    rows = filled_forward(dense_prefixes(panel, sorted({c for c, _ in cases})), "c").select(*SERIES, "c", "t", F.log(F.col("z") + 1).alias("x"))
    per = rows.groupBy(*SERIES, "c").agg(F.expr("regr_slope(x, t) FILTER (WHERE t < 12)").alias("slope"), F.expr("avg(x) FILTER (WHERE t < 12)").alias("mean"), F.map_from_entries(F.collect_list(F.struct("t", "x"))).alias("xs"))
    horizons = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(h).alias("h")) for c, h in cases])
    out = per.withColumn("case", F.explode(horizons)).where("c = case.c").withColumn("h", F.col("case.h"))
    season = lambda m: F.col("xs")[m] - F.col("mean") - F.col("slope") * (m - 5.5)
    last = F.col("xs")[F.col("c") - 1]
    raw = F.exp(last - season((F.col("c") - 1) % 12) + season((F.col("c") + F.col("h") - 1) % 12)) - 1
    y = F.exp(last) - 1
    return out.select(*KEYS, F.greatest(F.least(F.greatest(raw, 0.25 * y), 4 * y), F.lit(0.0)).alias("adapted"))


def v2_candidates(wide: DataFrame, ridge: str = "damped_trend") -> DataFrame:
    """V2_NAMES of pairs with seasonal_scaled, adapted and a ridge; where no ridge has been fitted the damped trend stands for it."""
    out = wide.withColumns({f"blend_{int(100 * w)}": blend(ridge, "seasonal_scaled", w) for w in WEIGHTS})
    return out.withColumn("adapted_mix", 0.25 * F.col("adapted") + 0.75 * F.col("seasonal_scaled"))


def policy_of(pairs: DataFrame, names: list[str], last_origin: int) -> DataFrame:
    """h, category, model, best_mae, base_mae from the pairs of the origins up to last_origin; the first name is the base."""
    tuned = pairs.where(F.col("c") <= last_origin).unpivot(["h", "category", "actual"], names, "model", "predicted")
    return gated_policy(tuned, names[0], names)


def chosen_value(pairs: DataFrame, policy: DataFrame, names: list[str], into: str, fixed: str | None = None) -> DataFrame:
    """into: each row's column that the policy names, the base where it names none; for 12 months the column `fixed`, if given."""
    model = F.coalesce("model", F.lit(names[0]))
    value = F.coalesce(*[F.when(model == n, F.col(n)) for n in names])
    if fixed is not None:
        value = F.when(F.col("h") == 12, F.col(fixed)).otherwise(value)
    named = F.broadcast(policy.select("h", "category", "model"))  # a row for each horizon and category
    return pairs.join(named, ["h", "category"], "left").withColumn(into, value).drop("model")


def common_parts(panel: DataFrame, cases: list[tuple[int, int]]) -> DataFrame:
    """k3, k6: the panel factor's forecasts with growth over three and six months."""
    rows = decomposed(panel, sorted({c for c, _ in cases}))
    local = rows.where(F.col("t") >= F.col("c") - 3).groupBy(*SERIES, "c").agg(F.median("d").alias("local"))
    both = growth(rows, 3).withColumnRenamed("growth", "g3").join(growth(rows, 6).withColumnRenamed("growth", "g6"), ["category", "c"])
    horizons = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(h).alias("h")) for c, h in cases])
    shared = by_category(rows).join(both, ["category", "c"]).withColumn("case", F.explode(horizons)).where("c = case.c").withColumn("h", F.col("case.h"))
    shared = shared.select("category", "c", "h", "g3", "g6", at_month("fs", F.col("c") + F.col("h") - 13).alias("f"))
    value = lambda g: F.greatest(F.exp(F.col("f") + F.col(g) + F.col("local")) - 1, F.lit(0.0))
    return local.join(shared, ["category", "c"]).select(*KEYS, value("g3").alias("k3"), value("g6").alias("k6"))


def v3_candidates(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """V3_NAMES of pairs with v2: the panel's forecasts at two weights with the scaled season, and half and half with v2."""
    out = pairs.join(common, KEYS)
    out = out.withColumns({f"panel_k{k}_w{int(100 * w)}": blend(f"k{k}", "seasonal_scaled", w) for k in (3, 6) for w in (0.25, 0.75)})
    return out.withColumns({f"v2_panel_k{k}": blend("v2", f"panel_k{k}_w75", 0.5) for k in (3, 6)}).drop("k3", "k6")

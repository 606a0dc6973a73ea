"""Forecasts with a national reference series that is known with a delay.

At origin c and delay lag only national months before c - lag are seen. Growth is the median of the last three yearly log
changes, within bounds; a later month's value is the latest seen month of the same calendar month times grown years.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clip
from .panel import SERIES, dense_prefixes, filled_both, in_months, mean_of_cents, month_index



@dataclass(frozen=True)
class Settings:
    """Windows in months, bounds of yearly log growth, and the weight of the pooled growth; checked when made."""

    growth_window: int = 3
    level_window: int = 3
    growth_clip: tuple[float, float] = (-0.1, 0.5)
    local_growth_clip: tuple[float, float] = (-0.2, 0.7)
    pooled_growth_weight: float = 0.75

    def __post_init__(self):
        number = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)
        for name in ("growth_window", "level_window"):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or not 1 <= v <= 12:
                raise ValueError(f"{name} has to be a whole number from 1 to 12")
        for name in ("growth_clip", "local_growth_clip"):
            v = getattr(self, name)
            if not isinstance(v, list | tuple) or len(v) != 2 or not all(map(number, v)) or v[0] >= v[1]:
                raise ValueError(f"{name} has to be two rising finite numbers")
        if not number(self.pooled_growth_weight) or not 0 <= self.pooled_growth_weight <= 1:
            raise ValueError("pooled_growth_weight has to be between 0 and 1")

    @classmethod
    def of(cls, text: str) -> "Settings":
        """From JSON text with every field and no other."""
        got, names = json.loads(text), {f.name for f in fields(cls)}
        if not isinstance(got, dict) or set(got) != names:
            raise ValueError(f"the settings need just {sorted(names)}")
        return cls(**got)


START = -48  # the national series begins four years before the panel


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, m, v: monthly mean order value of four market segments, and total, their sum."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(in_months("o_orderdate", START, 23)).select("o_custkey", "o_totalprice", month_index(F.col("o_orderdate")).alias("m"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_mktsegment") != "MACHINERY")
    one = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("field"), "m").agg(mean_of_cents("o_totalprice").alias("v"))
    total = one.groupBy("m").agg(F.sum(F.round(F.col("v") * 100).cast("long")).alias("cents")).select(F.lit("total").alias("field"), "m", (F.col("cents") / 100.0).alias("v"))
    return one.unionByName(total)


def seen(series: DataFrame, origins: list[int], lag: int) -> DataFrame:
    return series.withColumn("c", F.explode(F.array(*map(F.lit, origins)))).where(F.col("m") < F.col("c") - lag)


def growth(series: DataFrame, origins: list[int], lag: int, last: int = 3, bounds: tuple[float, float] = (-0.1, 0.5)) -> DataFrame:
    """field, c, g"""
    s = seen(series, origins, lag)
    year = s.select("field", "c", (F.col("m") + 12).alias("m"), F.col("v").alias("v12"))
    logs = s.join(year, ["field", "c", "m"]).withColumn("r", F.row_number().over(Window.partitionBy("field", "c").orderBy(F.desc("m")))).where(F.col("r") <= last)
    return logs.groupBy("field", "c").agg(clip(F.median(F.log(F.col("v") / F.col("v12"))), *bounds).alias("g"))


def carried(series: DataFrame, origins: list[int], lag: int, until: int = 12, settings: Settings = Settings()) -> DataFrame:
    """field, c, m, v for every month up to c + until - 1: seen values, and later ones grown from the same month of the latest seen year."""
    s = seen(series, origins, lag)
    maps = s.groupBy("field", "c").agg(F.map_from_entries(F.collect_list(F.struct("m", "v"))).alias("vs"), F.max("m").alias("end")).join(growth(series, origins, lag, settings.growth_window, settings.growth_clip), ["field", "c"])
    months = maps.withColumn("m", F.explode(F.sequence(F.lit(START), F.col("c") + until - 1)))
    steps = F.when(F.col("m") <= F.col("end"), 0).otherwise(F.ceil((F.col("m") - F.col("end")) / 12)).cast("int")
    return months.withColumn("k", steps).select("field", "c", "m", (F.try_element_at("vs", F.col("m") - 12 * F.col("k")) * F.exp(F.col("g") * F.col("k"))).alias("v")).where("v IS NOT NULL")


def field_of(fields: dict[str, str]) -> Column:
    """The national field of a row's category: total where the mapping has none."""
    named = [F.when(F.col("category") == c, F.lit(f)) for c, f in sorted(fields.items())]
    return F.coalesce(*named, F.lit("total"))


def level_forecasts(panel: DataFrame, series: DataFrame, cases: list[tuple[int, int]], lag: int = 1, fields: dict[str, str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """level1, level3, seasonal, local_blend and national_growth of each series.

    level1 and level3 are the last and the median of the last level_window (three) ratios of the series to the national one, times the
    national value of the target. The seasonal part grows by pooled and own yearly log changes; with no month more than a
    year of history by the national growth, and with less than a year it is level3. `fields` names the national field
    of a category; other categories take the total.
    """
    origins = sorted({c for c, _ in cases})
    rows = filled_both(dense_prefixes(panel, origins), "c").select(*SERIES, "c", "t", "z", field_of(fields or {}).alias("field"))
    used = series.where(F.col("field").isin("total", *(fields or {}).values()))
    ref = carried(used, origins, lag, settings=settings).select("field", "c", F.col("m").alias("t"), "v")
    year = rows.select(*SERIES, "c", (F.col("t") + 12).alias("t"), F.col("z").alias("z12"))
    near = lambda window: F.col("t") >= F.col("c") - window
    tail = rows.where(near(max(settings.level_window, settings.growth_window))).join(F.broadcast(ref), ["field", "c", "t"]).join(year, [*SERIES, "c", "t"], "left")  # ref: fields times origins times months
    per = tail.groupBy(*SERIES, "field", "c").agg(F.max_by("z", "t").alias("last"), F.max_by(F.col("z") / F.col("v"), "t").alias("r1"), F.median(F.when(near(settings.level_window), F.col("z") / F.col("v"))).alias("r3"), F.percentile(F.when(near(settings.growth_window), F.log(F.col("z") / F.col("z12"))), F.lit(0.5)).alias("own"))
    pooled = per.groupBy("category", "c").agg(F.percentile("own", F.lit(0.5)).alias("pooled"))
    g = growth(used, origins, lag, settings.growth_window, settings.growth_clip).select("field", "c", "g")
    horizons = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(h).alias("h")) for c, h in cases])
    out = per.join(pooled, ["category", "c"]).join(F.broadcast(g), ["field", "c"]).withColumn("case", F.explode(horizons)).where("c = case.c").withColumn("h", F.col("case.h")).drop("case")
    out = out.withColumn("t", F.col("c") + F.col("h") - 1).join(F.broadcast(ref), ["field", "c", "t"]).withColumnRenamed("v", "target_value")
    before = rows.select(*SERIES, "c", (F.col("t") + 12).alias("t"), F.col("z").alias("z_before"))
    out = out.join(before, [*SERIES, "c", "t"], "left")
    level1, level3 = F.col("r1") * F.col("target_value"), F.col("r3") * F.col("target_value")
    weight = settings.pooled_growth_weight
    grown = clip(weight * F.col("pooled") + (1 - weight) * F.col("own"), *settings.local_growth_clip)
    seasonal = F.coalesce(F.col("z_before") * F.exp(F.coalesce(grown, F.col("g"))), level3)
    return out.select(*SERIES, "c", "h", level1.alias("level1"), level3.alias("level3"), seasonal.alias("seasonal"), ((seasonal + (level1 + level3) / 2) / 2).alias("local_blend"), (F.col("last") * F.exp(F.col("g") * F.col("h") / 12)).alias("national_growth"))


def panel_recent(panel: DataFrame, cases: list[tuple[int, int]]) -> DataFrame:
    """exp(f[s] + f_last - f[last - 12] + z_last - f_last), s being the month a year before the target; needs 13 months."""
    origins = sorted({c for c, _ in cases if c >= 13})
    rows = filled_both(dense_prefixes(panel, origins), "c").select(*SERIES, "c", "t", F.log("z").alias("z"))
    f = rows.groupBy("category", "c", "t").agg(F.median("z").alias("f")).groupBy("category", "c").agg(F.map_from_entries(F.collect_list(F.struct("t", "f"))).alias("fs"))
    last = rows.where(F.col("t") == F.col("c") - 1).select(*SERIES, "c", "z")
    horizons = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(h).alias("h")) for c, h in cases])
    out = last.join(f, ["category", "c"]).withColumn("case", F.explode(horizons)).where("c = case.c").withColumn("h", F.col("case.h"))
    at = lambda t: F.try_element_at("fs", t)
    end = F.col("c") - 1
    return out.select(*SERIES, "c", "h", F.exp(at(F.col("c") + F.col("h") - 13) + at(end) - at(end - 12) + F.col("z") - at(end)).alias("panel_recent"))


def combined(parts: DataFrame, base: str = "base") -> DataFrame:
    """final: base for 3 and 6 months, level3 for 12, the mean of base, panel_recent and local_blend for 1."""
    h = F.col("h")
    return parts.withColumn("final", F.when(h == 12, F.col("level3")).when(h.isin(3, 6), F.col(base)).otherwise((F.col(base) + F.coalesce("panel_recent", "local_blend") + F.col("local_blend")) / 3))

"""Pooled ridge regression of log changes over all series and earlier origins, by pyspark.ml.

Features of a series at origin c and horizon h come from its filled prefix only. The label is the log change from the
last month to the target; rows weigh the square root of the level. Features are standardised without weights. Spark's
penalty stands for alpha as alpha / n * the label's weighted deviation.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import array_median
from . import news
from .panel import FIRST_YEAR, SERIES, coded, dense_prefixes, filled_forward

NEWS = ["rate", "moved", "moves", "age_of_news"]
BASE = ["level", "diff1", "diff2", "mean3", "mean6", "slope", "slope_h", "seasonal_diff", "yoy", "h12", "log_h", "has_season", "age"]


def feature_rows(panel: DataFrame, cases: list[tuple[int, int]], categories: int) -> DataFrame:
    """A row for each series and case with the numeric features, one-hot category and its harmonics of the target month."""
    rows = filled_forward(dense_prefixes(panel, sorted({c for c, _ in cases})), "c").withColumn("x", F.log(F.col("z") + 1))
    s = rows.groupBy(*SERIES, "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda p: p["x"]).alias("xs"), F.max_by("z", "t").alias("last"), F.expr("regr_slope(x, t) FILTER (WHERE t >= c - 6)").alias("slope"))
    s = coded(s).withColumn("h", F.explode(F.create_map(*[v for c in sorted({c for c, _ in cases}) for v in (F.lit(c), F.array(*[F.lit(h) for cc, h in cases if cc == c]))])[F.col("c")]))
    at = lambda k: F.try_element_at("xs", F.lit(-k))
    mean = lambda k: F.aggregate(F.slice("xs", -F.least(F.lit(k), F.size("xs")), F.lit(k)), F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(k), F.size("xs"))
    year = F.try_element_at("xs", F.col("c") + F.col("h") - 12)
    pairs = F.greatest(F.col("c") - 12, F.lit(0))
    yoy = array_median(F.zip_with(F.slice("xs", 13, pairs), F.slice("xs", 1, pairs), lambda a, b: a - b))
    slope = F.coalesce(F.col("slope"), F.lit(0.0)) * F.when(F.col("c") == 2, 0.5).otherwise(1.0)  # squares of the months about their mean count as 1 at least
    target = F.col("c") + F.col("h") - 1
    angle = lambda k: 2 * math.pi * k * target / 12
    wave = {f"{f}{k}": fn(angle(k)) for k in (1, 2) for f, fn in (("sin", F.sin), ("cos", F.cos))}
    out = s.withColumns({
        "level": at(1), "diff1": F.coalesce(at(2), at(1)) - at(1), "diff2": F.coalesce(at(3), at(2), at(1)) - at(1), "mean3": mean(3) - at(1), "mean6": mean(6) - at(1), "slope": slope,
        "slope_h": slope * F.least("h", F.lit(6)), "seasonal_diff": F.when(F.col("c") + F.col("h") > 12, F.coalesce(year - at(1), F.lit(0.0))).otherwise(0.0), "yoy": F.coalesce(yoy, F.lit(0.0)),
        "h12": F.col("h") / 12, "log_h": F.log1p("h"), "has_season": (F.col("c") + F.col("h") > 12).cast("double"), "age": F.col("c") / 24, **wave,
    })
    hot = {f"cat{i}": (F.col("code") == i).cast("double") for i in range(categories)}
    out = out.withColumns(hot)
    return out.withColumns({f"cat{i}_{w}": F.col(f"cat{i}") * F.col(w) for i in range(categories) for w in wave}).withColumn("target", target)


def with_news(rows: DataFrame, events: DataFrame, categories: int, first_year: int = FIRST_YEAR) -> DataFrame:
    """The four news features known at each origin's date, and their products with the one-hot category."""
    dates = rows.select("c").distinct().withColumn("as_of", F.add_months(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.col("c")))
    known = dates.join(news.features(dates.select("as_of").distinct(), events).withColumnRenamed("age", "age_of_news"), "as_of").drop("as_of")  # a row for each origin
    out = rows.join(F.broadcast(known), "c")
    return out.withColumns({f"cat{i}_{n}": F.col(f"cat{i}") * F.col(n) for i in range(categories) for n in NEWS})


def names(categories: int, known: bool = False) -> list[str]:
    by_category = ["sin1", "cos1", "sin2", "cos2", *(NEWS if known else ())]
    return [*BASE, *by_category, *(f"cat{i}" for i in range(categories)), *(f"cat{i}_{w}" for i in range(categories) for w in by_category)]


def standardised(train: DataFrame, other: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames with (x - mean) / deviation of the training rows as a vector.

    A column that is constant in training would be 0 there and so have no weight; it is left out, as the solver's penalty
    does not reach columns without variance.
    """
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    columns = [c for c in columns if stats[f"s_{c}"] and stats[f"s_{c}"] > 1e-12]
    put = {c: (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] for c in columns}
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    return tuple(assemble.transform(f.withColumns(put)) for f in (train, other))


def fit(train: DataFrame, alpha: float):
    """Weighted ridge on features, label, weight (weights have mean 1)."""
    s = train.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("m"), (F.sum(F.col("weight") * F.col("label") ** 2) / F.sum("weight")).alias("q")).first()
    sd = math.sqrt(max(s.q - s.m**2, 0.0))
    return LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False, weightCol="weight", regParam=alpha / s.n * sd).fit(train)


def forecasts(panel: DataFrame, cases: list[tuple[int, int]], alpha: float = 100.0, bounds: tuple[float, float] = (math.log(0.25), math.log(4.0)), events: DataFrame | None = None) -> DataFrame:
    """One model for each origin, fitted on sub-origins from 6 whose targets are before it; with events, on news known at each sub-origin too."""
    categories = panel.select("category").distinct().count()
    rows = feature_rows if events is None else lambda *a: with_news(feature_rows(*a), events, categories)
    out = None
    for c in sorted({c for c, _ in cases}):
        horizons = sorted({h for cc, h in cases if cc == c})
        known = panel.where(F.col("t") < c)
        train = rows(known, [(s, h) for s in range(6, c) for h in horizons if s + h - 1 < c], categories)
        train = train.join(known.select(*SERIES, F.col("t").alias("target"), "y"), [*SERIES, "target"]).withColumn("label", F.log1p("y") - F.log1p("last")).withColumn("raw", F.sqrt(F.greatest("last", F.lit(1.0))))
        train = train.withColumn("weight", F.col("raw") / train.select(F.avg("raw")).scalar())
        train, asked = standardised(train, rows(known, [(c, h) for h in horizons], categories), names(categories, events is not None))
        got = fit(train, alpha).transform(asked)
        change = F.greatest(F.least("prediction", F.lit(bounds[1])), F.lit(bounds[0]))
        one = got.select(*SERIES, "c", "h", F.greatest(F.expm1(F.log1p("last") + change), F.lit(0.0)).alias("predicted"))
        out = one if out is None else out.unionByName(one)
    return out

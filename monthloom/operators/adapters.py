"""Forecasters from outside: a registry, a season-adapting wrapper, gated libraries, and boosted trees."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip
from .factors import GROWTH_BOUNDS, decomposed, early_growths, growth
from .panel import SERIES, coded, dense_prefixes, filled_forward

#: name -> function of (histories as rows of an array, horizon) that gives a median forecast for each row
Forecaster = Callable[[np.ndarray, int], np.ndarray]
REGISTRY: dict[str, Forecaster] = {}


def register(name: str):
    def add(f: Forecaster) -> Forecaster:
        REGISTRY[name] = f
        return f

    return add


@register("last")
def _last(histories: np.ndarray, horizon: int) -> np.ndarray:
    return histories[:, -1]


def available(library: str) -> bool:
    return importlib.util.find_spec(library) is not None


def forecast(panel: DataFrame, name: str, c: int, h: int, adapted: bool = False, batch: int = 64) -> DataFrame:
    """predicted by a registered forecaster on filled prefixes of length c, in batches; never below 0."""
    if name not in REGISTRY:
        raise KeyError(f"no forecaster named {name}; registered: {sorted(REGISTRY)}")
    rows = filled_forward(dense_prefixes(panel, [c]), "c").groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "z"))), lambda p: p["z"]).alias("ys"))
    model = REGISTRY[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                y = np.array(part.ys.tolist(), float)
                p = season_adapted(model, y, h) if adapted else model(y, h)
                yield pd.DataFrame({"territory_id": part.territory_id, "category": part.category, "predicted": np.maximum(p, 0.0)})

    return rows.mapInPandas(run, f"territory_id {dict(rows.dtypes)['territory_id']}, category string, predicted double")


def season_adapted(model: Forecaster, y: np.ndarray, h: int) -> np.ndarray:
    """The first year's logs less their line, centred, are a profile that is taken out before the model and put back after.

    The result is kept within a quarter and four times the last value.
    """
    x, t = np.log1p(y[:, :12]), np.arange(12)
    slope = ((t - t.mean()) * (x - x.mean(axis=1, keepdims=True))).sum(axis=1) / ((t - t.mean()) ** 2).sum()
    profile = x - x.mean(axis=1, keepdims=True) - slope[:, None] * (t - t.mean())
    n = y.shape[1]
    flat = (y + 1) / np.exp(profile[:, np.arange(n) % 12])
    back = model(flat, h) * np.exp(profile[:, (n + h - 1) % 12]) - 1
    return np.clip(back, 0.25 * y[:, -1], 4 * y[:, -1])


def seasonal_library(panel: DataFrame, c: int, h: int, fourier: int | None = None) -> DataFrame:
    """A local additive model for each series by the prophet library, where it is installed."""
    if not available("prophet"):
        raise RuntimeError("prophet is not installed")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from prophet import Prophet

        m = Prophet(changepoint_prior_scale=0.05, seasonality_prior_scale=10, weekly_seasonality=False, daily_seasonality=False, yearly_seasonality=fourier is None)
        if fourier:
            m.add_seasonality("annual", 365.25, fourier)
        start = pd.Timestamp("1999-01-01")
        m.fit(pd.DataFrame({"ds": [start + pd.DateOffset(months=int(t)) for t in pdf.t], "y": pdf.y}))
        at = pd.DataFrame({"ds": [start + pd.DateOffset(months=c + h - 1)]})
        return pd.DataFrame({"territory_id": [pdf.territory_id.iloc[0]], "category": [pdf.category.iloc[0]], "predicted": [max(float(m.predict(at).yhat.iloc[0]), 0.0)]})

    return panel.where(F.col("t") < c).groupBy(*SERIES).applyInPandas(fit, f"territory_id {dict(panel.dtypes)['territory_id']}, category string, predicted double")


def boosted_features(rows: DataFrame, horizons: list[int]) -> DataFrame:
    """A row for each series, month t >= 5 and horizon, from d up to t: steps back, mean and slope of six months, target's season."""
    w = Window.partitionBy(*SERIES).orderBy("t")
    six = w.rowsBetween(-5, 0)
    x = rows.withColumns({"back1": F.lag("d", 1).over(w) - F.col("d"), "back2": F.lag("d", 2).over(w) - F.col("d"), "mean6": F.avg("d").over(six) - F.col("d"), "slope": F.regr_slope("d", F.col("t").cast("double")).over(six)})
    x = x.where("t >= 5").withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("m", F.pmod(F.col("t") + F.col("h"), F.lit(12)))
    season = {"sine": F.sin(2 * np.pi * F.col("m") / 12), "cosine": F.cos(2 * np.pi * F.col("m") / 12)}
    x = x.withColumns({"slope_h": F.col("slope") * F.least("h", F.lit(6)), **season, **{f"is{k}": (F.col("code") == k).cast("double") for k in range(6)}})
    ahead = rows.select(*SERIES, F.col("t").alias("target"), F.col("d").alias("d_ahead"))
    return x.withColumn("target", F.col("t") + F.col("h")).join(ahead, [*SERIES, "target"], "left")


FEATURES = ["d", "back1", "back2", "mean6", "slope", "slope_h", "h", "sine", "cosine", *(f"is{k}" for k in range(6))]


def boosted(panel: DataFrame, c: int, horizons: list[int], every: int = 3, rounds: int = 70, train_horizons: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """factor_boost: the factor a year before the target, grown, with the last d and its learned change within .2.

    One set of trees learns the changes of d over all horizons from the sixth month on, on every third series, weighted by
    the root of the value. An approximation: Spark's trees have a depth for a number of leaves, no median leaves and no leaf penalty.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = coded(decomposed(panel, [c]))
    x = boosted_features(rows, sorted({*train_horizons, *horizons})).withColumns({"label": F.col("d_ahead") - F.col("d"), "weight": F.sqrt(F.greatest(F.exp("z") - 1, F.lit(1.0)))})
    x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)
    train = x.where(F.col("label").isNotNull() & F.col("h").isin(*train_horizons) & (F.pmod(F.xxhash64(*SERIES), F.lit(every)) == 0))
    model = GBTRegressor(lossType="absolute", maxIter=rounds, maxDepth=4, stepSize=0.06, minInstancesPerNode=40, weightCol="weight", seed=1).fit(train.select("features", "label", "weight"))
    last = model.transform(x.where((F.col("t") == c - 1) & F.col("h").isin(*horizons)))
    f = rows.select("category", F.col("t").alias("target12"), F.col("f").alias("f_before")).distinct()
    grown = early_growths(rows, [c]) if c <= 12 else growth(rows, 3)
    level = F.col("f_before") + clip(F.col("growth"), *GROWTH_BOUNDS)
    out = last.withColumn("target12", F.col("target") - 12).join(f, ["category", "target12"]).join(grown.select("category", "growth"), "category")
    return out.select(*SERIES, F.lit(c).alias("c"), "h", F.greatest(F.exp(level + F.col("d") + clip(F.col("prediction"), -0.2, 0.2)) - 1, F.lit(0.0)).alias("factor_boost"))

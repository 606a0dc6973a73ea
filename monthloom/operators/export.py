"""Forecasts of all series from the last month, with status and intervals; delayed data; reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .baselines import baselines
from .panel import SERIES


def export(panel: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12), months: int = 24, q: DataFrame | None = None) -> DataFrame:
    """A row for each series and horizon: predicted, status, and lower and upper where q (h, q) is given."""
    out = baselines(panel, [(months, h) for h in horizons]).withColumn("predicted", F.col("seasonal_scaled"))
    seen = panel.groupBy(*SERIES).agg(F.count("y").alias("n"))
    out = out.join(seen, SERIES).withColumn("status", F.when(F.col("h") == 12, "diagnostic").when(F.col("n") < months, "incomplete").otherwise("ok"))
    if q is not None:
        out = out.join(F.broadcast(q), "h", "left").withColumn("lower", F.greatest(F.col("predicted") - F.col("q") * F.col("history_scale"), F.lit(0.0))).withColumn("upper", F.col("predicted") + F.col("q") * F.col("history_scale")).drop("q")
    return out


def delayed(panel: DataFrame, cases: list[tuple[int, int]]) -> DataFrame:
    """The same targets with one month less known: origin c - 1 and horizon h + 1, named by c and h."""
    late = baselines(panel, [(c - 1, h + 1) for c, h in cases])
    return late.withColumn("c", F.col("c") + 1).withColumn("h", F.col("h") - 1)


def markdown(rows: DataFrame, limit: int = 100) -> str:
    """A small result as a table of text."""
    got = rows.limit(limit).collect()
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in got)])

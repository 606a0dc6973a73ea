"""All queries of the library proper, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FOUND: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(fn):
        FOUND[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _load() -> None:
    from . import chain, checks, detection, forecasting, relational  # noqa: F401


def queries() -> dict:
    _load()
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["metrics_model_horizon"](spark, sf_dir)

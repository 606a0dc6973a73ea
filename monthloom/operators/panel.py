"""Panels: long observations (territory_id, category, t, y), one row for each observed series-month.

Series-level work is partitioned by (territory_id, category); a missing month is an absent row or a null, never NaN.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES = ["territory_id", "category"]
FIRST_YEAR, MONTHS = 1999, 24


def month_index(at: Column, first_year: int = FIRST_YEAR) -> Column:
    return (F.year(at) - first_year) * 12 + F.month(at) - 1


def in_months(at: str, first: int, last: int, first_year: int = FIRST_YEAR) -> Column:
    """Whether a date lies in the months first..last: comparisons with literals, by which Parquet skips row groups."""
    start = lambda m: F.lit(date(first_year + m // 12, m % 12 + 1, 1)).cast("timestamp")
    return (F.col(at) >= start(first)) & (F.col(at) < start(last + 1))


def mean_of_cents(money: str) -> Column:
    """Mean of money through integer cents, the same in whatever order rows come."""
    return F.sum(F.round(F.col(money) * 100).cast("long")) / (F.lit(100.0) * F.count(F.lit(1)))


def order_panel(spark: SparkSession, sf_dir: str, first: int = 0, last: int = MONTHS - 1) -> DataFrame:
    """Mean order value by customer nation, order priority (and ALL) and month."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(in_months("o_orderdate", first, last)).select("o_custkey", "o_orderpriority", "o_totalprice", month_index(F.col("o_orderdate")).alias("t"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("territory_id"))
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    rows = rows.select("territory_id", F.explode(F.array("o_orderpriority", F.lit("ALL"))).alias("category"), "t", "o_totalprice")
    return rows.groupBy("territory_id", "category", "t").agg(mean_of_cents("o_totalprice").alias("y"))


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean line value by supplier and month: one category."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(in_months("l_shipdate", 0, MONTHS - 1)).select("l_suppkey", "l_extendedprice", month_index(F.col("l_shipdate")).alias("t"))
    return lines.groupBy(F.col("l_suppkey").alias("territory_id"), F.lit("ALL").alias("category"), "t").agg(mean_of_cents("l_extendedprice").alias("y"))


def dense(panel: DataFrame, months: int = MONTHS) -> DataFrame:
    """Every series with every month; y is null where nothing was observed."""
    calendar = panel.select(*SERIES).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
    return calendar.join(panel, [*SERIES, "t"], "left")


def by_series(*more: str) -> Window:
    return Window.partitionBy(*SERIES, *more)


def filled_forward(d: DataFrame, *more: str) -> DataFrame:
    """z: y carried forward; a gap at the start has the mean of the observed values."""
    w = by_series(*more)
    return d.withColumn("z", F.coalesce(F.last("y", True).over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)), F.avg("y").over(w)))


def filled_both(d: DataFrame, *more: str) -> DataFrame:
    """z: y carried forward, then backward, at least 1."""
    w = by_series(*more).orderBy("t")
    z = F.coalesce(F.last("y", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("y", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return d.withColumn("z", F.when(z.isNotNull(), F.greatest(z, F.lit(1.0))))


def complete(panel: DataFrame, months: int = MONTHS) -> DataFrame:
    """Series observed in every month."""
    return panel.withColumn("n", F.count("y").over(by_series())).where(F.col("n") == months).drop("n")


def prefixes(panel: DataFrame, origins: list[int]) -> DataFrame:
    """Rows known at each origin c: t < c."""
    return panel.withColumn("c", F.explode(F.array(*map(F.lit, origins)))).where("t < c")


def dense_prefixes(panel: DataFrame, origins: list[int]) -> DataFrame:
    """As prefixes, with every month; series without an observed month before c are left out."""
    known = prefixes(panel, origins)
    grid = known.select(*SERIES, "c").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return grid.join(known, [*SERIES, "c", "t"], "left")


def coded(panel: DataFrame) -> DataFrame:
    """code: place of the category in the sorted list of categories."""
    names = panel.select("category").distinct()
    codes = names.withColumn("code", F.dense_rank().over(Window.orderBy("category")) - 1)  # a row for each category
    return panel.join(F.broadcast(codes), "category")


def expectations(obs: DataFrame) -> DataFrame:
    """One row of violation counts: nulls, duplicate keys, values that are not finite or below zero, months not of the form YYYY-MM."""
    nulls = sum(F.when(F.col(c).isNull(), 1).otherwise(0) for c in ("date", "territory_id", "category", "y"))
    keyed = obs.groupBy("territory_id", "category", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(nulls).alias("nulls"), F.sum(F.when(F.isnan("y") | F.col("y").isin(float("inf"), float("-inf")), 1).otherwise(0)).alias("odd"),
        F.sum(F.when(F.col("y") < 0, 1).otherwise(0)).alias("negative"), F.sum(F.when(~F.col("date").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), 1).otherwise(0)).alias("bad_dates"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return keyed.agg(total("nulls").alias("nulls"), total(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("duplicates"), total("odd").alias("not_finite"), total("negative").alias("negative"), total("bad_dates").alias("bad_dates"))


def validated(obs: DataFrame) -> DataFrame:
    """The panel of an observation table with date, territory_id, category and value or consumption; raises on any violation."""
    value = next((c for c in ("value", "consumption") if c in obs.columns), None)
    if value is None or not {"date", "territory_id", "category"} <= set(obs.columns):
        raise ValueError("the observations need date, territory_id, category, and value or consumption")
    obs = obs.select("date", F.col("territory_id").cast("long").alias("territory_id"), "category", F.col(value).cast("double").alias("y"))
    found = {k: v for k, v in expectations(obs).first().asDict().items() if v}
    if found:
        raise ValueError(f"the observations break expectations: {found}")
    ordinal = F.expr("cast(split(date, '-')[0] as int) * 12 + cast(split(date, '-')[1] as int) - 1")
    start = obs.select(F.min(ordinal)).scalar()
    return obs.select("territory_id", "category", (ordinal - start).alias("t"), "y")

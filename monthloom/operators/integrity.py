"""Checks of results: each gives violation counts, which are zero where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detectors import yearly


def duplicate_keys(rows: DataFrame, *keys: str) -> int:
    return rows.groupBy(*keys).count().where("count > 1").count()


def not_finite(rows: DataFrame, *columns: str) -> int:
    bad = None
    for c in columns:
        b = F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
        bad = b if bad is None else bad | b
    return rows.where(bad).count()


def differing_actuals(pairs: DataFrame, panel: DataFrame) -> int:
    """Pairs whose actual is not the panel's value of the target month."""
    source = panel.select("territory_id", "category", F.col("t").alias("target"), "y")
    return pairs.join(source, ["territory_id", "category", "target"], "left").where(~F.col("actual").eqNullSafe(F.col("y"))).count()


def overlapping(a: DataFrame, b: DataFrame, key: str = "territory_id") -> int:
    return a.select(key).intersect(b.select(key)).count()


def different_sets(a: DataFrame, b: DataFrame) -> int:
    """Rows in one frame only."""
    return a.exceptAll(b).count() + b.exceptAll(a).count()


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_first and only_second, the numbers of distinct rows that one frame has alone."""
    sides = a.distinct().withColumn("__side", F.lit(1)).unionByName(b.distinct().withColumn("__side", F.lit(2)))
    per = sides.groupBy(*a.columns).agg(F.sum("__side").alias("s"))
    return per.agg(F.count(F.when(F.col("s") == 1, 1)).alias("only_first"), F.count(F.when(F.col("s") == 2, 1)).alias("only_second"))


def replayed(stored: DataFrame, panel: DataFrame, long_pairs: DataFrame, long_stored: DataFrame, used: DataFrame, policy: DataFrame) -> DataFrame:
    """One row of counts: repeated keys, values that are not finite, actuals unlike the panel's, mean errors unlike those of the
    stored pairs, used models (h, category, model) unlike the policy's; and the number of pairs."""
    keys = ["territory_id", "category", "c", "h"]
    one = lambda df, name, value: df.agg(value.cast("long").alias(name))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    repeats = one(stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "duplicates", F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))
    source = panel.select("territory_id", "category", F.col("t").alias("target"), "y")
    wrong = one(stored.join(source, ["territory_id", "category", "target"], "left").where(~F.col("actual").eqNullSafe(F.col("y"))), "wrong_actuals", F.count(F.lit(1)))
    mae = lambda df, name: df.groupBy("model", "h", "category").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias(name))
    errors = one(mae(long_pairs, "m").join(mae(long_stored, "again"), ["model", "h", "category"], "full").where(~F.coalesce(F.abs(F.col("m") - F.col("again")) <= 1e-6, F.lit(False))), "wrong_errors", F.count(F.lit(1)))
    choices = one(used.join(policy.select("h", "category", F.col("model").alias("chosen")), ["h", "category"]).where("model <> chosen"), "wrong_choices", F.count(F.lit(1)))
    whole = stored.agg(F.count(F.when(bad("actual") | bad("seasonal_scaled"), 1)).alias("not_finite"), F.count(F.lit(1)).alias("pairs"))
    return repeats.join(whole).join(wrong).join(errors).join(choices).select("duplicates", "not_finite", "wrong_actuals", "wrong_errors", "wrong_choices", "pairs")  # one row each


def news_before_available(signals: DataFrame, events: DataFrame) -> int:
    """Signals that name an event which was not known before their date."""
    named = signals.where("known_news_ids <> ''").select("as_of", F.explode(F.split("known_news_ids", ";")).alias("event_id"))
    return named.join(F.broadcast(events.select("event_id", "available")), "event_id", "left").where("available IS NULL OR available >= as_of").count()


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", left_unique: bool = True) -> DataFrame:
    """A join whose right keys, and left keys for one-to-one, have to be unique."""
    for side, rows in (("right", right), *((("left", left),) if left_unique else ())):
        if n := duplicate_keys(rows, *on):
            raise ValueError(f"{n} keys repeat on the {side} side")
    return left.join(right, on, how)


def looked_up(rows: DataFrame, index: DataFrame, on: list[str], value: str) -> DataFrame:
    """rows with the value of an index with unique keys; a key that the index lacks is an error when its row is read."""
    if n := duplicate_keys(index, *on):
        raise ValueError(f"{n} keys repeat in the index")
    found = rows.join(index.select(*on, F.col(value).alias("__value"), F.lit(True).alias("__there")), on, "left")
    missing = F.raise_error(F.concat(F.lit("not in the index: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on])))
    return found.withColumn(value, F.when(F.col("__there").isNull(), missing.cast(dict(index.dtypes)[value])).otherwise(F.col("__value"))).drop("__value", "__there")


def case_study(panel: DataFrame, alarms: DataFrame, events: DataFrame, before: list[int], after: list[int]) -> DataFrame:
    """For each event (territory_id, event_t, available_t): alarm months at or after it, whether the news was known then, and
    relative_gap, the mean relative yearly growth (in points, against the median series) in the months after less those before."""
    gap = relative_growth(panel).groupBy("territory_id").agg((F.avg(F.when(F.col("t").isin(after), F.col("relative"))) - F.avg(F.when(F.col("t").isin(before), F.col("relative")))).alias("relative_gap"))
    seen = events.join(alarms.select("territory_id", "t"), "territory_id", "left").where("t IS NULL OR t >= event_t")
    found = seen.groupBy("territory_id", "event_t").agg(F.sort_array(F.collect_set("t")).alias("alarm_months"), F.bool_or(F.col("t") >= F.col("available_t")).alias("news_known"))
    return events.join(found, ["territory_id", "event_t"], "left").join(gap, "territory_id", "left")


def relative_growth(panel: DataFrame) -> DataFrame:
    """relative: a series' yearly log change less its category's median of the month, in points."""
    change = yearly(panel)
    factor = change.groupBy("category", "t").agg(F.median("change").alias("factor"))
    return change.join(factor, ["category", "t"]).select("territory_id", "category", "t", ((F.col("change") - F.col("factor")) * 100).alias("relative"))


def case_history(panel: DataFrame, found: dict[str, DataFrame], events: DataFrame) -> DataFrame:
    """A row for each event and observed month of its territory: actual, relative growth, an alarm flag for each method, and
    whether the news was known when the month had ended."""
    rows = events.select("territory_id", "event_t", "available_t").join(panel, "territory_id").join(relative_growth(panel), ["territory_id", "category", "t"], "left")
    for method, alarms in found.items():
        marked = alarms.select("territory_id", "t").distinct().withColumn(method, F.lit(True))
        rows = rows.join(marked, ["territory_id", "t"], "left").withColumn(method, F.coalesce(method, F.lit(False)))
    return rows.select("territory_id", "event_t", "t", F.col("y").alias("actual"), "relative", *found, (F.col("available_t") <= F.col("t")).alias("news_known"))

"""News known at a date: as-of features, and events around alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Announcements of a reference rate, moved into the panel's window: id, day it was known, rate, change.
EVENTS = (("n1", "1999-02-10", 7.5, 0.0), ("n2", "1999-04-21", 8.5, 1.0), ("n3", "1999-08-15", 12.0, 3.5), ("n4", "1999-09-15", 13.0, 1.0), ("n5", "1999-10-27", 15.0, 2.0), ("n6", "1999-12-15", 16.0, 1.0), ("n7", "2000-07-26", 18.0, 2.0), ("n8", "2000-09-13", 19.0, 1.0), ("n9", "2000-10-25", 21.0, 2.0))


def events(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(EVENTS), "event_id string, available string, rate double, delta double")
    return rows.withColumn("available", F.to_date("available"))


def features(dates: DataFrame, known: DataFrame) -> DataFrame:
    """as_of with rate / 25, sum and count of changes in 90 days / 10 and / 5, age of the last event (a year at most) / 365.

    An event counts from the day after it became available. dates: one row for each date, as a list of origins is.
    """
    near = dates.join(F.broadcast(known), known.available < dates.as_of, "left")
    recent = F.col("available") >= F.date_sub("as_of", 90)
    out = near.groupBy("as_of").agg(
        F.coalesce(F.max_by("rate", F.struct("available", "event_id")) / 25, F.lit(0.0)).alias("rate"), F.coalesce(F.sum(F.when(recent, F.col("delta"))) / 10, F.lit(0.0)).alias("moved"),
        (F.count(F.when(recent & (F.col("delta") != 0), 1)) / 5).alias("moves"), F.max("available").alias("at"),
    )
    return out.select("as_of", "rate", "moved", "moves", F.when(F.col("at").isNull(), 0.0).otherwise(F.least(F.datediff("as_of", "at"), F.lit(365)) / 365).alias("age"))


def around(alarms: DataFrame, known: DataFrame, days: int = 90) -> DataFrame:
    """alarms (as_of) with the ids of events with a change that became known in the days before, joined by ';'."""
    moves = known.where("delta <> 0").select("event_id", "available")
    per_date = alarms.select("as_of").distinct().join(F.broadcast(moves), (F.col("available") < F.col("as_of")) & (F.col("available") >= F.date_sub("as_of", days)), "left")
    ids = per_date.groupBy("as_of").agg(F.array_join(F.sort_array(F.collect_list("event_id")), ";").alias("known_news_ids"))
    return alarms.join(ids, "as_of", "left")


def latest(known: DataFrame) -> DataFrame:
    return known.withColumn("r", F.row_number().over(Window.orderBy(F.desc("available"), F.desc("event_id")))).where("r = 1").drop("r")

"""Control charts on a stream: one state for each key, the same folds as in batch.

Values arrive as (key, t, z). A key's state is its chart's sums or last values, and its last alarm; rows that come late within one
micro-batch are put in order, rows older than what a key has seen are left out, as a score is never backdated. A null z gives a row
with score 0 and leaves the chart as it is.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, t long, score double, warning boolean, alarm boolean, direction int"
STATE = "held array<double>, last long, seen long"

#: A chart: values held by the state and z -> values held then, signed statistic that is 1 at the threshold.
Step = Callable[[list[float], float], tuple[list[float], float]]


def _cusum(threshold: float, drift: float = 0.5) -> Step:
    def step(held, z):
        up, down = held or (0.0, 0.0)
        up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
        return [up, down], (up if up >= down else -down) / threshold or (1e-300 if up >= down else -1e-300)

    return step


def _ewma(threshold: float, weight: float = 0.3) -> Step:
    scale = math.sqrt(weight / (2 - weight)) * threshold

    def step(held, z):
        m = weight * z + (1 - weight) * (held[0] if held else 0.0)
        return [m], m / scale

    return step


def _window_mean(threshold: float, width: int = 3) -> Step:
    def step(held, z):
        held = [*held, z][-width:]
        return held, sum(held) / len(held) * math.sqrt(len(held)) / threshold

    return step


def _median3(threshold: float) -> Step:
    def step(held, z):
        held = [*held, min(max(z, -3.0), 3.0)][-6:]
        return held, float(np.median(held[-3:])) * math.sqrt(3) / threshold if len(held) >= 3 else 0.0

    return step


CHARTS = {"cusum": _cusum, "ewma": _ewma, "window_mean": _window_mean, "median3": _median3}
COOLDOWN = {"median3": 6}


def chart(method: str = "cusum", threshold: float = 4.0, cooldown: int | None = None, **options):
    """The step function of a chart for applyInPandasWithState."""
    step_of = CHARTS[method](threshold, **options)
    pause = COOLDOWN.get(method, 3) if cooldown is None else cooldown

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, seen = state.get if state.exists else ([], -1000, -(1 << 62))
        held = list(held)
        rows = sorted((int(t), math.nan if pd.isna(z) else float(z)) for f in frames for t, z in zip(f.t, f.z, strict=True))
        out = []
        for t, z in rows:
            if t <= seen:
                continue
            seen = t
            if math.isnan(z):
                out.append((key[0], t, 0.0, False, False, 0))
                continue
            held, value = step_of(held, z)
            score = abs(value) if abs(value) > 1e-299 else 0.0
            alarm = score >= 1 and t - last > pause
            if alarm:
                held, last = [], t
            out.append((key[0], t, score, score >= 0.7, alarm, (value > 0) - (value < 0)))
        state.update((held, last, seen))
        yield pd.DataFrame(out, columns=["key", "t", "score", "warning", "alarm", "direction"])

    return step


def charted(stream: DataFrame, **options) -> DataFrame:
    """A streaming frame (key string, t long, z double) with a chart for each key."""
    return stream.groupBy("key").applyInPandasWithState(chart(**options), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (event type), t (hours since 1970), z: hourly counts less the mean of the hours before, over their deviation; null before twelve."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("key"), (F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600).cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    z = (F.col("n") - F.avg("n").over(w)) / F.greatest(F.stddev_pop("n").over(w), F.lit(1e-9))
    return e.select("key", "t", F.when(F.count("n").over(w) >= 12, z).alias("z"))


def replayed(spark: SparkSession, rows: DataFrame, parts: int = 3, **options) -> DataFrame:
    """The chart's rows after playing `rows` through a file stream in `parts` micro-batches in order of time."""
    from pyspark.sql.types import StructType

    folder = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    edges = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    schema = StructType.fromDDL("key string, t long, z double")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in/*")
    if edges.a is None:
        return spark.createDataFrame([], OUT)
    step = (edges.b - edges.a) // parts + 1
    for k in range(parts):
        rows.where(F.col("t").between(edges.a + k * step, edges.a + (k + 1) * step - 1)).coalesce(1).write.parquet(f"{folder}/in/{k}")
        q = charted(source, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")

"""Online change detection: scores that use months up to t only, and alarms with cooldown.

Innovations and panel scores come from windows; charts keep a state that an alarm resets, so each is one fold over a
series' ordered array. A series is an array of months, which is bounded by the panel's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import array_mad, array_median, clip, let
from .panel import SERIES, dense


def in_order() -> Window:
    return Window.partitionBy(*SERIES).orderBy("t")


def innovations(panel: DataFrame, months: int = 24) -> DataFrame:
    """t, z: the standardised error of a one-step forecast of ln(1 + y); null where it can't be made.

    From t = 6 with six months seen. With the month a year before: that plus the median of the last six yearly changes;
    else the last month plus .8 of the slope of the last six times the gap. The error is centred and scaled by the
    median and the deviation (at least .03) of the twelve errors before, once there are six, and kept within 12.
    """
    x = dense(panel, months).withColumn("x", F.log(F.col("y") + 1))
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("x12", F.lag("x", 12).over(in_order())).withColumn("change", F.col("x") - F.col("x12"))
    x = x.withColumn("seen", F.collect_list(F.when(F.col("x").isNotNull(), F.struct("t", "x"))).over(before)).withColumn("changes", F.slice(F.reverse(F.collect_list("change").over(before)), 1, 6))
    last = F.slice(F.reverse("seen"), 1, 6)
    x = x.withColumn("last6", last).withColumn("n", F.size("seen"))
    total = lambda f: F.aggregate("last6", F.lit(0.0), lambda a, p: a + f(p))
    k = F.size("last6")
    mt, mx = F.try_divide(total(lambda p: p["t"]), k), F.try_divide(total(lambda p: p["x"]), k)
    x = x.withColumn("mt", mt).withColumn("mx", mx)
    slope = F.try_divide(total(lambda p: (p["t"] - F.col("mt")) * (p["x"] - F.col("mx"))), total(lambda p: (p["t"] - F.col("mt")) * (p["t"] - F.col("mt"))))
    newest = F.get("last6", F.lit(0))
    pred = F.when(F.col("x12").isNotNull(), F.col("x12") + F.coalesce(array_median(F.col("changes")), F.lit(0.0))).otherwise(newest["x"] + 0.8 * slope * (F.col("t") - newest["t"]))
    x = x.withColumn("e", F.when((F.col("t") >= 6) & (F.col("n") >= 6) & F.col("x").isNotNull(), F.col("x") - pred))
    x = x.withColumn("errors", F.slice(F.reverse(F.collect_list("e").over(before)), 1, 12))
    z = (F.col("e") - array_median(F.col("errors"))) / array_mad(F.col("errors"), 0.03)
    return x.select(*SERIES, "t", F.when((F.size("errors") >= 6) & F.col("e").isNotNull(), clip(z, -12, 12)).alias("z"))


def folded(z: DataFrame, step, state: Column, score_of) -> DataFrame:
    """One row for each month from a fold over the series' months in order.

    step(state, z) gives the new state; score_of(state) its score and direction; alarm and cooldown are added by the fold.
    """
    arrays = z.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("zs"))
    out = arrays.withColumn("out", _fold("zs", step, state, score_of)).select(*SERIES, F.explode("out").alias("o"))
    return out.select(*SERIES, "o.*")


def _fold(zs: str, step, empty: Column, score_of, cooldown: int = 3) -> Column:
    row = "array<struct<t:int,score:double,warning:boolean,alarm:boolean,direction:int>>"
    start = F.struct(empty.alias("s"), F.lit(-1000).alias("last"), F.array().cast(row).alias("out"))

    def moved(a: Column, p: Column) -> Column:
        t, z = p["t"].cast("int"), p["z"]

        def scored(s: Column) -> Column:
            score, direction = score_of(s)
            return let(F.struct(score.alias("score"), direction.cast("int").alias("direction")), lambda q: after(s, q))

        def after(s: Column, q: Column) -> Column:
            alarm = (q["score"] >= 1) & (t - a["last"] > cooldown)
            seen = F.struct(t.alias("t"), q["score"].alias("score"), (q["score"] >= 0.7).alias("warning"), alarm.alias("alarm"), q["direction"].alias("direction"))
            return F.struct(F.when(alarm, empty).otherwise(s).alias("s"), F.when(alarm, t).otherwise(a["last"]).alias("last"), F.concat(a["out"], F.array(seen)).cast(row).alias("out"))

        missing = F.struct(t.alias("t"), F.lit(0.0).alias("score"), F.lit(False).alias("warning"), F.lit(False).alias("alarm"), F.lit(0).alias("direction"))
        kept = F.struct(a["s"].alias("s"), a["last"].alias("last"), F.concat(a["out"], F.array(missing)).cast(row).alias("out"))
        return F.when(z.isNull(), kept).otherwise(let(step(a["s"], z), scored))

    return F.aggregate(zs, start, moved, lambda a: a["out"])


def cusum(z: DataFrame, threshold: float, drift: float = 0.5) -> DataFrame:
    """Two one-sided sums with drift; score is the larger over the threshold."""
    empty = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    step = lambda s, z: F.struct(F.greatest(F.lit(0.0), s["up"] + z - drift).alias("up"), F.greatest(F.lit(0.0), s["down"] - z - drift).alias("down"))
    return folded(z, step, empty, lambda s: (F.greatest(s["up"], s["down"]) / threshold, F.when(s["up"] >= s["down"], 1).otherwise(-1)))


def ewma(z: DataFrame, threshold: float, weight: float = 0.3) -> DataFrame:
    """Exponentially weighted mean over its deviation."""
    scale = math.sqrt(weight / (2 - weight)) * threshold
    empty = F.struct(F.lit(0.0).alias("m"))
    return folded(z, lambda s, z: F.struct((weight * z + (1 - weight) * s["m"]).alias("m")), empty, lambda s: (F.abs(s["m"]) / scale, F.signum(s["m"])))


def window_mean(z: DataFrame, threshold: float, width: int = 3) -> DataFrame:
    """Mean of the last values since the last alarm, times the root of their number."""
    empty = F.struct(F.array().cast("array<double>").alias("w"))
    step = lambda s, z: F.struct(F.slice(F.concat(s["w"], F.array(z)), -F.least(F.lit(width), F.size(s["w"]) + 1), F.lit(width)).alias("w"))

    def score(s):
        m = F.aggregate(s["w"], F.lit(0.0), lambda a, x: a + x) / F.size(s["w"])
        return F.abs(m) * F.sqrt(F.size(s["w"])) / threshold, F.signum(m)

    return folded(z, step, empty, score)


def robust(z: DataFrame, method: str, threshold: float) -> DataFrame:
    """median3: root three times the median of the last three; multiscale: the largest of sum / root k over the last k = 2..6.

    Values are kept within 3, a cooldown of six months follows an alarm, and an alarm empties the window.
    """
    empty = F.struct(F.array().cast("array<double>").alias("w"))
    step = lambda s, z: F.struct(F.slice(F.concat(s["w"], F.array(F.greatest(F.least(z, F.lit(3.0)), F.lit(-3.0)))), -F.least(F.lit(6), F.size(s["w"]) + 1), F.lit(6)).alias("w"))

    def score(s):
        w, n = s["w"], F.size(s["w"])
        if method == "median3":
            v = F.when(n >= 3, array_median(F.slice(w, -F.least(F.lit(3), n), F.lit(3))) * math.sqrt(3)).otherwise(0.0)
        else:
            sums = [F.when(n >= k, F.aggregate(F.slice(w, -F.least(F.lit(k), n), F.lit(k)), F.lit(0.0), lambda a, x: a + x) / math.sqrt(k)).otherwise(0.0) for k in range(2, 7)]
            v = F.aggregate(F.array(*sums), F.lit(0.0), lambda a, x: F.when(F.abs(x) > F.abs(a), x).otherwise(a))
        return F.abs(v) / threshold, F.signum(v)

    arrays = z.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("zs"))
    return arrays.withColumn("out", _fold("zs", step, empty, score, cooldown=6)).select(*SERIES, F.explode("out").alias("o")).select(*SERIES, "o.*")


def factor_and_spread(panel: DataFrame) -> DataFrame:
    """category, t, factor, spread: median and deviation (at least .02) of the yearly log changes across series."""
    c = yearly(panel)
    f = c.groupBy("category", "t").agg(F.median("change").alias("factor"))
    away = c.join(f, ["category", "t"]).withColumn("away", F.abs(F.col("change") - F.col("factor")))
    return away.groupBy("category", "t").agg(F.first("factor").alias("factor"), F.greatest(1.4826 * F.median("away"), F.lit(0.02)).alias("spread"))


def yearly(panel: DataFrame) -> DataFrame:
    before = panel.select(*SERIES, (F.col("t") + 12).alias("t"), F.col("y").alias("y12"))
    return panel.join(before, [*SERIES, "t"]).select(*SERIES, "t", (F.log(F.col("y") + 1) - F.log(F.col("y12") + 1)).alias("change"))


def panel_scores(panel: DataFrame) -> DataFrame:
    """z: a series' yearly log change against the category's, over the spread."""
    return yearly(panel).join(factor_and_spread(panel), ["category", "t"]).select(*SERIES, "t", ((F.col("change") - F.col("factor")) / F.col("spread")).alias("z"))


def panel_window(z: DataFrame, width: int) -> DataFrame:
    """score: mean of the last `width` months' z where all of them are there."""
    w = Window.partitionBy(*SERIES).orderBy("t").rangeBetween(-(width - 1), 0)
    return z.withColumn("k", F.count("z").over(w)).withColumn("m", F.avg("z").over(w)).where(F.col("k") == width).select(*SERIES, "t", F.abs("m").alias("score"))


def change_scores(panel: DataFrame, width: int, months: int = 24, factor: DataFrame | None = None) -> DataFrame:
    """Confirmed shifts: the smallest of the last `width` residuals' distances from the median of the six before them.

    The residual is ln(1 + y) less the category's median of the month, or the month's f of a table `factor` (t, f); distances count in units of 1.4826 times the
    deviation of all earlier month-to-month differences, at least .015, and only when all have the same sign.
    """
    x = dense(panel, months).withColumn("x", F.log(F.col("y") + 1))
    of = x.join(F.broadcast(factor), "t") if factor is not None else x.join(x.groupBy("category", "t").agg(F.median("x").alias("f")), ["category", "t"])  # factor: a row for each month
    r = of.withColumn("r", F.col("x") - F.col("f")).withColumn("diff", F.col("r") - F.lag("r").over(in_order()))
    r = r.withColumn("diffs", F.collect_list("diff").over(in_order().rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("ref", F.collect_list("r").over(in_order().rowsBetween(-width - 5, -width))).withColumn("recent", F.collect_list("r").over(in_order().rowsBetween(-width + 1, 0)))
    shifts = F.transform("recent", lambda v: v - array_median(F.col("ref")))
    same = F.forall(shifts, lambda v: v > 0) | F.forall(shifts, lambda v: v < 0)
    whole = (F.col("t") >= 12) & (F.size("ref") == 6) & (F.size("recent") == width) & (F.size("diffs") > 0)
    score = F.array_min(F.transform(shifts, F.abs)) / array_mad(F.col("diffs"), 0.015)
    return r.select(*SERIES, "t", F.when(whole & same, score).otherwise(0.0).alias("score"))


def alarms_at(scores: DataFrame, thresholds: list[float], cooldown: int = 3) -> DataFrame:
    """threshold, t: months with score at a threshold or over it that are more than `cooldown` after its last alarm, greedily."""
    hits = scores.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))).where(F.col("score") >= F.col("threshold"))
    hits = hits.groupBy(*SERIES, "threshold").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    none = F.array().cast("array<int>")
    kept = F.aggregate("ts", none, lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(F.concat(F.array(F.lit(-1000)), a), -1) > cooldown), F.concat(a, F.array(t.cast("int")))).otherwise(a))
    return hits.select(*SERIES, "threshold", F.explode(kept).alias("t"))


def alarms(scores: DataFrame, threshold: float, cooldown: int = 3) -> DataFrame:
    return alarms_at(scores, [threshold], cooldown).drop("threshold")


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the digest of the parts, the same in every engine and run."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


SYNTHETIC = ("none", "outlier", "up", "down", "slope")


def synthetic(spark: SparkSession, seed: str, cases: int, length: int = 60) -> DataFrame:
    """case_id, kind, change, t, y: made series with a trend, a season and noise in logs, a fifth each of five kinds.

    The change starts at 14 to 17 in 24 months, else at 28 to 42; up and down shift the level by .12 to .35, slope adds
    .015 to .035 a month from the change on, and an outlier is one month of twice the shift.
    """
    first, span = (14, 4) if length == 24 else (28, 15)  # fixed values, as are the ranges below
    rows = spark.range(cases).withColumn("kind", F.explode(F.array(*map(F.lit, SYNTHETIC)))).withColumn("case_id", F.concat_ws("-", F.lit(seed), F.lit(length), "kind", "id"))
    u = lambda name, lo, hi: F.lit(lo) + F.lit(hi - lo) * uniform(F.col("case_id"), F.lit(name))
    rows = rows.select("case_id", "kind", (F.lit(first) + F.floor(uniform("case_id", F.lit("at")) * span)).cast("int").alias("at"), u("sigma", 0.02, 0.07).alias("sigma"), u("base", 6.0, 10.0).alias("base"), u("trend", -0.002, 0.01).alias("trend"),
                       u("season", 0.03, 0.16).alias("season"), u("phase", 0.0, 6.28).alias("phase"), u("size", 0.12, 0.35).alias("size"), u("rise", 0.015, 0.035).alias("rise"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    noise = F.sqrt(-2 * F.log(1 - uniform("case_id", "t", F.lit("a")))) * F.cos(2 * math.pi * uniform("case_id", "t", F.lit("b")))
    after, kind = F.col("t") >= F.col("at"), F.col("kind")
    moved = (
        F.when((kind == "up") & after, F.col("size")).when((kind == "down") & after, -F.col("size")).when((kind == "slope") & after, (F.col("t") - F.col("at")) * F.col("rise"))
        .when((kind == "outlier") & (F.col("t") == F.col("at")), 2 * F.col("size")).otherwise(0.0)
    )
    x = F.col("base") + F.col("trend") * F.col("t") + F.col("season") * F.sin(2 * math.pi * F.col("t") / 12 + F.col("phase")) + F.col("sigma") * noise + moved
    return rows.select("case_id", "kind", F.when(~kind.isin("none", "outlier"), F.col("at")).alias("change"), "t", F.expm1(x).alias("y"))


KINDS = ("control", "level_up_10", "level_up_20", "level_down_10", "level_down_20", "slope_up", "outlier")


def injected(panel: DataFrame, seed: str = "case") -> DataFrame:
    """Each complete series in seven kinds: untouched, a lasting level change of 10 or 20 %, a slope, or one outlier month.

    The change starts at 15 to 19 by a hash of series and kind; control and outlier have none to find.
    """
    rows = panel.withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("territory_id").cast("string"), "category", "kind").cast("binary"))
    rows = rows.withColumn("at", (F.conv(F.substring(key, 1, 6), 16, 10).cast("long") % 5 + 15).cast("int"))
    after = F.col("t") >= F.col("at")
    factor = (  # fixed values: the sizes of the changes
        F.when((F.col("kind") == "level_up_10") & after, 1.1).when((F.col("kind") == "level_up_20") & after, 1.2).when((F.col("kind") == "level_down_10") & after, 0.9).when((F.col("kind") == "level_down_20") & after, 0.8)
        .when((F.col("kind") == "slope_up") & after, F.exp(0.03 * (F.col("t") - F.col("at") + 1))).when((F.col("kind") == "outlier") & (F.col("t") == F.col("at")), 1.3).otherwise(1.0)
    )
    return rows.select(*SERIES, "kind", F.when(~F.col("kind").isin("control", "outlier"), F.col("at")).alias("change"), "t", (F.col("y") * factor).alias("y"))


def case_scores(cases: DataFrame, found: DataFrame, tolerance: int = 2, keys: tuple[str, ...] = ("case_id",), by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each `by`: tp, fp, fn, precision, recall, f1, control rate, median delay. cases: by, keys, kind, change; found: by, keys, t.

    A case is hit by any alarm from its change to `tolerance` after; all other alarms, and repeats, are false.
    """
    inside = F.col("t").between(F.col("change"), F.col("change") + tolerance)
    per = cases.join(found, [*by, *keys], "left").groupBy(*by, *keys, "kind", "change").agg(F.count("t").alias("alarms"), F.min(F.when(inside, F.col("t"))).alias("first"))
    hit = F.when(F.col("first").isNotNull(), 1).otherwise(0)
    s = per.groupBy(*by).agg(
        F.sum(hit).alias("tp"), F.sum(F.col("alarms") - hit).alias("fp"), F.sum(F.when(F.col("change").isNotNull(), 1 - hit).otherwise(0)).alias("fn"),
        F.avg(F.when(F.col("kind").isin("control", "none"), (F.col("alarms") > 0).cast("int"))).alias("control_rate"), F.median(F.col("first") - F.col("change")).alias("delay"),
    )
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return s.select(*by, "tp", "fp", "fn", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), "control_rate", "delay")


def chosen_quiet(scores: DataFrame, *groups: str, limit: float = 0.05) -> DataFrame:
    """By group the row with the best f1, then the lower control rate, among control rates within the limit; else the least rate; then the lower threshold."""
    ok = F.col("control_rate") <= limit
    order = F.struct((~ok).cast("int").alias("a"), F.when(ok, -F.col("f1")).otherwise(F.col("control_rate")).alias("b"), F.col("control_rate").alias("c"), F.col("threshold").alias("d"))
    return scores.groupBy(*groups).agg(F.min_by(F.struct(*[c for c in scores.columns if c not in groups]), order).alias("r")).select(*groups, "r.*")


def chosen(scores: DataFrame, limit: float = 0.05) -> DataFrame:
    """The row (threshold, f1, control_rate) with the best f1 among control rates within the limit, the lower threshold on a tie; else the least rate."""
    ok = F.col("control_rate") <= limit
    order = F.struct((~ok).cast("int").alias("a"), F.when(ok, -F.col("f1")).otherwise(F.col("control_rate")).alias("b"), F.when(ok, F.col("threshold")).otherwise(-F.col("f1")).alias("c"), F.col("threshold").alias("d"))
    return scores.agg(F.min_by(F.struct(*scores.columns), order).alias("r")).select("r.*")


def chosen_by_f1(scores: DataFrame, *groups: str) -> DataFrame:
    """By group the row with the best f1; then the lower control rate, then the higher threshold."""
    order = F.struct("f1", (-F.col("control_rate")).alias("quiet"), F.col("threshold").alias("t"))
    return scores.groupBy(*groups).agg(F.max_by(F.struct(*[c for c in scores.columns if c not in groups]), order).alias("r")).select(*groups, "r.*")


def chosen_across(scores: DataFrame, limit: float = 0.1) -> DataFrame:
    """One row (method, threshold, f1, control_rate): the best mean f1 over lengths among those whose largest control rate is
    within the limit, by method's name on a tie; if there is none, the least such rate, then the best f1."""
    per = scores.groupBy("method", "threshold").agg(F.avg("f1").alias("f1"), F.max("control_rate").alias("control_rate"))
    ok = F.col("control_rate") <= limit
    order = F.struct((~ok).cast("int").alias("a"), F.when(ok, -F.col("f1")).otherwise(F.col("control_rate")).alias("b"), F.when(ok, F.lit(0.0)).otherwise(-F.col("f1")).alias("c"), F.col("method").alias("d"), F.col("threshold").alias("e"))
    return per.agg(F.min_by(F.struct(*per.columns), order).alias("r")).select("r.*")

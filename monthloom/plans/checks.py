"""Queries on sources, sinks, validated joins and integrity: what is written is read back, what is stored is computed anew."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources as S
from ..functions import tidy
from ..operators import baselines as B
from ..operators import integrity as I
from ..operators import metrics as M
from ..operators import panel as P
from ..operators import policy as Q
from ..streaming.charts import shared
from .chain import KEY
from .ctes import BASE, OBS
from .ctes import tidy as t
from .registry import query
from .relational import EXPORT, CONFORMAL, POLICY, _policy, pairs


def _folder(spark, name: str) -> str:
    return f"{shared(spark)}/monthloom/{name}-{uuid.uuid4().hex}"


def _observations(spark, d):
    """The panel in the form of an observation file."""
    month = F.date_format(F.add_months(F.make_date(F.lit(P.FIRST_YEAR), F.lit(1), F.lit(1)), F.col("t")), "yyyy-MM")
    return P.order_panel(spark, d).select(month.alias("date"), F.col("territory_id").cast("int").alias("territory_id"), "category", F.col("y").alias("value"))


OBSERVED = f"WITH {OBS} SELECT printf('%04d-%02d', 1999 + t // 12, t % 12 + 1) AS date, CAST(territory_id AS INTEGER) AS territory_id, category, {t('y')} AS value FROM obs"


def _shown(rows):
    return rows.select("date", "territory_id", "category", tidy("value").alias("value"))


@query(OBSERVED)
def csv_round_trip(spark, d):
    path = _folder(spark, "csv")
    S.write_csv(_observations(spark, d), path, gzip=False)
    return _shown(S.csv(spark, path, S.OBSERVATIONS))


@query(OBSERVED)
def gzip_csv_round_trip(spark, d):
    path = _folder(spark, "csv-gz")
    S.write_csv(_observations(spark, d), path)
    return _shown(S.csv(spark, path, S.OBSERVATIONS))


@query(OBSERVED)
def json_round_trip(spark, d):
    path = _folder(spark, "json")
    S.write_json_lines(_observations(spark, d), path)
    return _shown(S.json_rows(spark, path, S.OBSERVATIONS, lines=True))


@query(f"WITH {OBS} SELECT territory_id, category, t, {t('y')} AS y FROM obs")
def validated_panel(spark, d):
    """The observation file read, checked and counted in months."""
    path = _folder(spark, "panel")
    S.write_csv(_observations(spark, d), path)
    return P.validated(S.csv(spark, path, S.OBSERVATIONS)).select(F.col("territory_id").cast("long").alias("territory_id"), "category", F.col("t").cast("int").alias("t"), tidy("y").alias("y"))


@query(f"WITH {BASE} SELECT {KEY}, {t('seasonal_scaled')} AS predicted, {t('actual')} AS actual FROM paired WHERE c IN (18, 21)")
def origin_partitions(spark, d):
    """Pairs written by origin in files of bounded rows; two origins are read back, the others' files are not opened."""
    path = _folder(spark, "origins")
    S.write_parquet(pairs(spark, d).withColumn("origin", F.col("c")), path, rows_a_file=5000, by=["origin"])
    return S.parquet(spark, path).where(F.col("origin").isin(18, 21)).select("territory_id", "category", "c", "h", tidy("seasonal_scaled").alias("predicted"), tidy("actual").alias("actual"))


@query(f"WITH {BASE}, s AS (SELECT *, 'k' || h AS label FROM wide) SELECT w.territory_id, w.category, w.c, w.h, {t('w.seasonal_scaled')} AS predicted, {t('a.actual')} AS actual FROM wide w JOIN paired a USING ({KEY})")
def one_to_one_join(spark, d):
    panel = P.order_panel(spark, d)
    forecasts = B.baselines(panel).select("territory_id", "category", "c", "h", "seasonal_scaled")
    return I.validated_join(forecasts, pairs(spark, d).select("territory_id", "category", "c", "h", "actual"), ["territory_id", "category", "c", "h"]).select("territory_id", "category", "c", "h", tidy("seasonal_scaled").alias("predicted"), tidy("actual").alias("actual"))


@query(f"WITH {OBS}, codes AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM obs)) SELECT territory_id, category, t, code, {t('y')} AS y FROM obs JOIN codes USING (category)")
def many_to_one_join(spark, d):
    panel = P.order_panel(spark, d)
    codes = P.coded(panel).select("category", F.col("code").cast("long").alias("code")).distinct()
    return I.validated_join(panel, codes, ["category"], left_unique=False).select("territory_id", "category", "t", "code", tidy("y").alias("y"))


@query(f"WITH {BASE} SELECT w.territory_id, w.category, w.c, w.h, {t('w.last_value')} AS predicted, {t('o.y')} AS actual FROM wide w LEFT JOIN obs o ON o.territory_id = w.territory_id AND o.category = w.category AND o.t = w.target")
def left_join_actuals(spark, d):
    panel = P.order_panel(spark, d)
    actual = panel.select("territory_id", "category", F.col("t").alias("target"), "y")
    return I.validated_join(B.baselines(panel), actual, ["territory_id", "category", "target"], "left", left_unique=False).select("territory_id", "category", "c", "h", tidy("last_value").alias("predicted"), tidy("y").alias("actual"))


@query(f"WITH {BASE} SELECT {KEY}, {t('o.y')} AS actual FROM wide w JOIN obs o USING (territory_id, category) WHERE o.t = w.target")
def asserted_lookup(spark, d):
    """The panel's value of each pair's target month; a pair whose month is not there would be an error."""
    index = P.order_panel(spark, d).select("territory_id", "category", F.col("t").alias("target"), F.col("y").alias("actual"))
    return I.looked_up(pairs(spark, d).drop("actual"), index, ["territory_id", "category", "target"], "actual").select("territory_id", "category", "c", "h", tidy("actual").alias("actual"))


@query(f"WITH {POLICY} SELECT h, category, model, to_json({{'h': h, 'category': category, 'model': model}}) AS text FROM policy")
def policy_json(spark, d):
    """The policy as a JSON text a row, and its fields read from that text."""
    text = _policy(spark, d)[1].select(F.to_json(F.struct("h", "category", "model")).alias("text"))
    return text.withColumn("p", F.from_json("text", "h int, category string, model string")).select("p.*", "text")


@query(f"""WITH {OBS}, a AS (SELECT DISTINCT territory_id, category FROM obs WHERE t < 12), b AS (SELECT territory_id, category FROM obs GROUP BY ALL HAVING count(*) = 24)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_second""")
def series_set_differences(spark, d):
    """Series of the first year against the complete ones."""
    panel = P.order_panel(spark, d)
    return I.set_differences(panel.where("t < 12").select(*P.SERIES).distinct(), P.complete(panel).select(*P.SERIES).distinct())


@query(f"""WITH {POLICY}, dup AS (SELECT count(*) AS n FROM paired GROUP BY {KEY}), mae AS (SELECT model, h, category, avg(abs(predicted - actual)) AS m, sum(abs(predicted - actual)) / count(*) AS again FROM long GROUP BY ALL),
used AS (SELECT l.h, l.category, l.model FROM long l JOIN policy USING (h, category, model) WHERE c >= 18 GROUP BY ALL),
again AS (SELECT h, category, CASE WHEN h <> 12 AND min(mae) <= 0.98 * max(mae) FILTER (WHERE model = 'seasonal_naive') THEN arg_min(model, (mae, place)) ELSE 'seasonal_naive' END AS model FROM e GROUP BY h, category)
SELECT (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM dup) AS duplicates, (SELECT count(*) FROM paired WHERE actual IS NULL OR isnan(actual) OR isinf(actual) OR seasonal_scaled IS NULL OR isnan(seasonal_scaled) OR isinf(seasonal_scaled)) AS not_finite,
  (SELECT count(*) FROM paired p LEFT JOIN obs o ON o.territory_id = p.territory_id AND o.category = p.category AND o.t = p.target WHERE o.y IS DISTINCT FROM p.actual) AS wrong_actuals,
  (SELECT count(*) FROM mae WHERE abs(m - again) > 1e-6) AS wrong_errors, (SELECT count(*) FROM used JOIN again USING (h, category) WHERE used.model <> again.model) AS wrong_choices, (SELECT count(*) FROM paired) AS pairs""")
def integrity_replay(spark, d):
    """Violations found by computing stored things anew: keys, values, actuals, errors of the written pairs, choices of the policy."""
    panel, rows = P.order_panel(spark, d), pairs(spark, d)
    path = _folder(spark, "replay")
    S.write_parquet(rows, path)
    stored = S.parquet(spark, path)
    chosen, policy = _policy(spark, d)
    used = Q.applied(chosen.where("c >= 18"), policy).select("h", "category", "model").distinct()
    return I.replayed(stored, panel, B.long(rows), B.long(stored), used, policy)


@query(f"""WITH q AS (SELECT * FROM (WITH {CONFORMAL} SELECT h, q FROM q)), e AS (SELECT * FROM (WITH {EXPORT} SELECT w.*, s.n FROM wide w JOIN (SELECT territory_id, category, count(*) AS n FROM obs GROUP BY ALL) s USING (territory_id, category)))
SELECT territory_id, category, h, {t('seasonal_scaled')} AS predicted, CASE WHEN h = 12 THEN 'diagnostic' WHEN n < 24 THEN 'incomplete' ELSE 'ok' END AS status, {t('greatest(seasonal_scaled - q * history_scale, 0)', 3)} AS lower, {t('seasonal_scaled + q * history_scale', 3)} AS upper FROM e LEFT JOIN q USING (h)""")
def export_intervals(spark, d):
    from ..operators.export import export

    rows = B.long(pairs(spark, d)).where("model = 'seasonal_scaled' AND c <= 18 AND h < 12")
    per = rows.groupBy("h", "territory_id").agg(F.max(F.abs(F.col("predicted") - F.col("actual")) / F.col("history_scale")).alias("score"))
    out = export(P.order_panel(spark, d), q=Q.order_statistic(per, "score", 0.9, "h"))
    return out.select(*P.SERIES, "h", tidy("predicted").alias("predicted"), "status", tidy("lower", 3).alias("lower"), tidy("upper", 3).alias("upper"))


COHORT_METRICS = f"""{BASE}, ranked AS (SELECT territory_id, row_number() OVER (ORDER BY sha256('42:' || territory_id), territory_id) AS place FROM (SELECT DISTINCT territory_id FROM obs)), cohort AS (SELECT territory_id, CASE place % 3 WHEN 0 THEN 'tuning' WHEN 1 THEN 'calibration' ELSE 'test' END AS cohort FROM ranked)"""


@query(f"WITH {COHORT_METRICS} SELECT cohort, model, h, count(*) AS n, {t('avg(abs(predicted - actual))')} AS mae, {t('sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0)', 6)} AS wape FROM long JOIN cohort USING (territory_id) GROUP BY ALL")
def metrics_cohort(spark, d):
    """Errors by thirds of the territories in hash order."""
    from ..operators import cohorts as C

    ranked = C.hash_ranked(P.order_panel(spark, d).select("territory_id").distinct(), "42")
    cohort = ranked.select("territory_id", F.when(F.col("place") % 3 == 0, "tuning").when(F.col("place") % 3 == 1, "calibration").otherwise("test").alias("cohort"))
    rows = I.validated_join(B.long(pairs(spark, d)), cohort, ["territory_id"], left_unique=False)
    return M.by_group(rows, "cohort", "model", "h").select("cohort", "model", "h", "n", "mae", "wape")

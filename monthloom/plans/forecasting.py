"""Queries on factor, national and news forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tidy
from ..operators import baselines as B
from ..operators import factors as A
from ..operators import national as N
from ..operators import metrics as M
from ..operators import news, ridge
from ..operators import panel as P
from ..operators.policy import blend
from .ctes import BASE, DENSE, OBS
from .ctes import tidy as t
from .registry import query
from .relational import pairs

CASES = B.CASES
ORIGINS = sorted({c for c, _ in CASES})
CASE_ROWS = ", ".join(f"({c}, {h})" for c, h in CASES)
VALUE = lambda x: f"greatest(exp({x}) - 1, 0)"

FACTORS = f"""{OBS}, {DENSE}, o(c) AS (VALUES {', '.join(f'({c})' for c in ORIGINS)}), fc(c, h) AS (VALUES {CASE_ROWS}),
visible AS (SELECT d.*, o.c FROM dense d JOIN o ON d.t < o.c),
means AS (SELECT territory_id, category, c, avg(y) AS m FROM visible GROUP BY ALL HAVING count(y) > 0),
zs AS (SELECT v.territory_id, v.category, v.c, v.t, ln(coalesce(last_value(v.y IGNORE NULLS) OVER (PARTITION BY v.territory_id, v.category, v.c ORDER BY v.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), m) + 1) AS z FROM visible v JOIN means USING (territory_id, category, c)),
fs AS (SELECT category, c, t, median(z) AS f FROM zs GROUP BY ALL),
ds AS (SELECT zs.*, f, z - f AS d FROM zs JOIN fs USING (category, c, t))"""


@query(f"WITH {FACTORS} SELECT category, c, t, {t('f', 6)} AS f FROM fs")
def panel_factor(spark, d):
    return A.decomposed(P.order_panel(spark, d), ORIGINS).select("category", "c", "t", tidy("f", 6).alias("f")).distinct()


@query(f"WITH {FACTORS} SELECT territory_id, category, c, t, {t('d', 6)} AS d FROM ds")
def factor_residuals(spark, d):
    return A.decomposed(P.order_panel(spark, d), ORIGINS).select(*P.SERIES, "c", "t", tidy("d", 6).alias("d"))


def _growth_sql(k: int) -> str:
    return f"g{k} AS (SELECT a.category, a.c, coalesce(quantile_cont(a.f - b.f, 0.5), 0) AS g FROM fs a LEFT JOIN fs b ON a.category = b.category AND a.c = b.c AND a.t = b.t + 12 WHERE a.t >= a.c - {k} GROUP BY ALL)"


def _candidates(k: int) -> None:
    def run(spark, d):
        return A.panel_candidates(P.order_panel(spark, d), CASES, k).select(*P.SERIES, "c", "h", tidy("common", 3).alias("common"))

    run.__name__ = f"panel_candidates_k{k}"
    query(f"""WITH {FACTORS}, {_growth_sql(k)}, l AS (SELECT territory_id, category, c, median(d) AS l FROM ds WHERE t >= c - 3 GROUP BY ALL)
    SELECT l.territory_id, l.category, l.c, fc.h, {t(VALUE('fs.f + g + l'), 3)} AS common FROM l JOIN g{k} USING (category, c) JOIN fc USING (c) JOIN fs ON fs.category = l.category AND fs.c = l.c AND fs.t = l.c + fc.h - 13""")(run)


_candidates(3)
_candidates(6)

EARLY = ", ".join(f"({c}, {t0}, CAST({w!r} AS DOUBLE))" for c in ORIGINS if c <= 12 for t0, w in enumerate(A.trend_weights(list(range(c)))))
MEMBERS = f"""{FACTORS}, ew(c, t, w) AS (VALUES {EARLY}), eg AS (SELECT category, c, least(greatest(sum(w * f), -0.2), 0.7) AS e FROM fs JOIN ew USING (c, t) GROUP BY ALL), tail AS (SELECT a.*, a.z - b.z AS zy, a.f - b.f AS fy FROM ds a LEFT JOIN ds b ON a.territory_id = b.territory_id AND a.category = b.category AND a.c = b.c AND a.t = b.t + 12 WHERE a.t >= a.c - 3),
per AS (SELECT territory_id, category, c, arg_max(d, t) AS dl, median(d) AS d3, quantile_cont(zy, 0.5) AS own0, quantile_cont(fy, 0.5) AS fy0 FROM tail GROUP BY ALL),
grown AS (SELECT per.*, least(greatest(coalesce(fy0, e, 0), -0.2), 0.7) AS g, coalesce(own0, least(greatest(coalesce(fy0, e, 0), -0.2), 0.7)) AS own FROM per LEFT JOIN eg USING (category, c)),
mem AS (SELECT p.territory_id, p.category, p.c, fc.h, {VALUE('s.z')} AS seasonal, {VALUE('s.z + g')} AS pooled_growth, {VALUE('s.z + 0.75 * g + 0.25 * own')} AS shrink_growth, {VALUE('s.f + g + 0.7 * dl + 0.3 * d3')} AS factor_state,
  {VALUE('s.f + g + pow(0.8, fc.h) * (0.7 * dl + 0.3 * d3) + (1 - pow(0.8, fc.h)) * s.d')} AS factor_damped
  FROM grown p JOIN fc USING (c) JOIN ds s ON s.territory_id = p.territory_id AND s.category = p.category AND s.c = p.c AND s.t = p.c + fc.h - 13)"""


@query(f"WITH {MEMBERS} SELECT territory_id, category, c, h, {', '.join(f'{t(m, 3)} AS {m}' for m in A.MEMBERS)} FROM mem")
def v4_members(spark, d):
    return A.members(P.order_panel(spark, d), CASES).select(*P.SERIES, "c", "h", *[tidy(m, 3).alias(m) for m in A.MEMBERS])


NATIONAL = """nat1 AS (SELECT c_mktsegment AS field, (year(o_orderdate) - 1999) * 12 + month(o_orderdate) - 1 AS m, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100.0 * count(*)) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY' AND (year(o_orderdate) - 1999) * 12 + month(o_orderdate) - 1 BETWEEN -48 AND 23 GROUP BY 1, 2),
nat AS (SELECT * FROM nat1 UNION ALL SELECT 'total', m, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS DOUBLE) / 100.0 FROM nat1 GROUP BY m)"""


def _grown(lag: int) -> str:
    return f"""{NATIONAL}, no(c) AS (VALUES {', '.join(f'({c})' for c in NAT_ORIGINS)}), seen AS (SELECT n.*, no.c FROM nat n JOIN no ON n.m < no.c - {lag}),
yoy AS (SELECT a.field, a.c, a.m, ln(a.v / b.v) AS g, row_number() OVER (PARTITION BY a.field, a.c ORDER BY a.m DESC) AS r FROM seen a JOIN seen b ON a.field = b.field AND a.c = b.c AND a.m = b.m + 12),
grown AS (SELECT field, c, least(greatest(median(g), -0.1), 0.5) AS g FROM yoy WHERE r <= 3 GROUP BY ALL),
ends AS (SELECT field, c, max(m) AS last_m FROM seen GROUP BY ALL),
carried AS (SELECT s.field, s.c, q.m, s.v * exp(g * q.k) AS v FROM (SELECT field, c, last_m, g, unnest(range(-48, c + 12)) AS m FROM ends JOIN grown USING (field, c)) e
  JOIN LATERAL (SELECT e.m AS m, CASE WHEN e.m <= e.last_m THEN 0 ELSE CAST(ceil((e.m - e.last_m) / 12.0) AS INTEGER) END AS k) q ON TRUE JOIN seen s ON s.field = e.field AND s.c = e.c AND s.m = q.m - 12 * q.k)"""


#: National fields of two categories; the others take the total.
FIELDS = {"1-URGENT": "AUTOMOBILE", "5-LOW": "HOUSEHOLD"}
FIELD_SQL = "CASE d.category " + " ".join(f"WHEN '{c}' THEN '{f}'" for c, f in FIELDS.items()) + " ELSE 'total' END"
NAT_CASES = [(3, 12), (9, 12), *B.CASES]
NAT_ORIGINS = sorted({c for c, _ in NAT_CASES})


@query(f"WITH {NATIONAL} SELECT field, m, {t('v')} AS v FROM nat")
def national_series(spark, d):
    return N.national(spark, d).select("field", "m", tidy("v").alias("v"))


@query(f"WITH {_grown(1)} SELECT field, c, {t('g', 8)} AS g FROM grown")
def national_growth(spark, d):
    return N.growth(N.national(spark, d), NAT_ORIGINS, 1).withColumn("g", tidy("g", 8))


@query(f"WITH {_grown(2)} SELECT field, c, m, {t('v', 3)} AS v FROM carried")
def national_carried_lag2(spark, d):
    return N.carried(N.national(spark, d), NAT_ORIGINS, 2).withColumn("v", tidy("v", 3))


def _levels(lag: int) -> str:
    rows = ", ".join(f"({c}, {h})" for c, h in NAT_CASES)
    return f"""{OBS}, {DENSE}, {_grown(lag)}, nc(c, h) AS (VALUES {rows}),
nk AS (SELECT territory_id, category, no.c FROM obs JOIN no ON obs.t < no.c GROUP BY ALL),
nz AS (SELECT d.territory_id, d.category, k.c, d.t, greatest(coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY d.territory_id, d.category, k.c ORDER BY d.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(y IGNORE NULLS) OVER (PARTITION BY d.territory_id, d.category, k.c ORDER BY d.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 1) AS z, {FIELD_SQL} AS field FROM dense d JOIN nk k ON d.territory_id = k.territory_id AND d.category = k.category AND d.t < k.c),
ref AS (SELECT field, c, m AS t, v FROM carried),
ntail AS (SELECT a.*, r.v, ln(a.z / b.z) AS own FROM nz a JOIN ref r ON r.c = a.c AND r.t = a.t AND r.field = a.field LEFT JOIN nz b ON a.territory_id = b.territory_id AND a.category = b.category AND a.c = b.c AND a.t = b.t + 12 WHERE a.t >= a.c - 3),
np AS (SELECT territory_id, category, field, c, arg_max(z, t) AS last, arg_max(z / v, t) AS r1, median(z / v) AS r3, quantile_cont(own, 0.5) AS own FROM ntail GROUP BY ALL),
pool AS (SELECT category, c, quantile_cont(own, 0.5) AS pooled FROM np GROUP BY ALL),
lv AS (SELECT np.territory_id, np.category, np.c, nc.h, r1 * ref.v AS level1, r3 * ref.v AS level3, CASE WHEN s.z IS NULL THEN r3 * ref.v ELSE s.z * exp(CASE WHEN own IS NULL THEN g ELSE least(greatest(0.75 * pooled + 0.25 * own, -0.2), 0.7) END) END AS seasonal, last * exp(g * nc.h / 12) AS national_growth
  FROM np JOIN pool USING (category, c) JOIN nc USING (c) JOIN ref ON ref.c = np.c AND ref.field = np.field AND ref.t = np.c + nc.h - 1 JOIN grown ON grown.c = np.c AND grown.field = np.field
  LEFT JOIN nz s ON s.territory_id = np.territory_id AND s.category = np.category AND s.c = np.c AND s.t = np.c + nc.h - 13),
levels AS (SELECT *, (seasonal + (level1 + level3) / 2) / 2 AS local_blend FROM lv)"""


LEVELS = ("level1", "level3", "seasonal", "local_blend", "national_growth")


def _register_levels(name: str, lag: int) -> None:
    def run(spark, d):
        return N.level_forecasts(P.order_panel(spark, d), N.national(spark, d), NAT_CASES, lag, FIELDS).select(*P.SERIES, "c", "h", *[tidy(c, 3).alias(c) for c in LEVELS])

    run.__name__ = name
    query(f"WITH {_levels(lag)} SELECT territory_id, category, c, h, {', '.join(f'{t(c, 3)} AS {c}' for c in LEVELS)} FROM levels")(run)


_register_levels("national_levels", 1)
_register_levels("lag2_sensitivity", 2)


@query(f"WITH {_levels(1)} SELECT territory_id, category, c, h, {t('level3', 3)} AS level3, {t('national_growth', 3)} AS national_growth FROM levels WHERE h = 12 AND c IN (3, 9)")
def annual_short_prefix(spark, d):
    rows = N.level_forecasts(P.order_panel(spark, d), N.national(spark, d), [(3, 12), (9, 12)], 1, FIELDS)
    return rows.select(*P.SERIES, "c", "h", tidy("level3", 3).alias("level3"), tidy("national_growth", 3).alias("national_growth"))


RECENT = """lnz AS (SELECT territory_id, category, c, t, ln(z) AS z FROM nz), lf AS (SELECT category, c, t, median(z) AS f FROM lnz GROUP BY ALL),
recent AS (SELECT l.territory_id, l.category, l.c, nc.h, exp(s.f + e.f - b.f + l.z - e.f) AS panel_recent FROM lnz l JOIN nc USING (c) JOIN lf e ON e.category = l.category AND e.c = l.c AND e.t = l.c - 1
  JOIN lf b ON b.category = l.category AND b.c = l.c AND b.t = l.c - 13 JOIN lf s ON s.category = l.category AND s.c = l.c AND s.t = l.c + nc.h - 13 WHERE l.t = l.c - 1)"""


@query(f"WITH {_levels(1)}, {RECENT} SELECT territory_id, category, c, h, {t('panel_recent', 3)} AS panel_recent FROM recent")
def panel_recent(spark, d):
    return N.panel_recent(P.order_panel(spark, d), NAT_CASES).where("panel_recent IS NOT NULL").select(*P.SERIES, "c", "h", tidy("panel_recent", 3).alias("panel_recent"))


EVENTS = "ev(event_id, available, rate, delta) AS (VALUES " + ", ".join(f"('{i}', DATE '{a}', {r}, {x})" for i, a, r, x in news.EVENTS) + ")"


@query(f"""WITH {EVENTS}, dates AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of FROM orders WHERE year(o_orderdate) IN (1999, 2000)),
j AS (SELECT d.as_of, e.*, e.available >= d.as_of - 90 AS recent FROM dates d LEFT JOIN ev e ON e.available < d.as_of)
SELECT as_of, coalesce(arg_max(rate, (available, event_id)) / 25, 0) AS rate, coalesce(sum(delta) FILTER (WHERE recent) / 10, 0) AS moved, count(*) FILTER (WHERE recent AND delta <> 0) / 5.0 AS moves,
  {t("CASE WHEN max(available) IS NULL THEN 0 ELSE least(as_of - max(available), 365) / 365.0 END", 6)} AS age FROM j GROUP BY as_of""")
def asof_news_features(spark, d):
    dates = spark.read.parquet(f"{d}/orders.parquet").where(F.year("o_orderdate").isin(1999, 2000)).select(F.trunc("o_orderdate", "month").alias("as_of")).distinct()
    return news.features(dates, news.events(spark)).withColumn("age", tidy("age", 6))


WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)


@query(f"WITH {BASE} SELECT territory_id, category, c, h, {', '.join(f'{t(f'{w} * damped_trend + {1 - w} * seasonal_scaled')} AS blend_{int(100 * w)}' for w in WEIGHTS)} FROM paired")
def blend_candidates(spark, d):
    return pairs(spark, d).select(*P.SERIES, "c", "h", *[tidy(blend("damped_trend", "seasonal_scaled", w)).alias(f"blend_{int(100 * w)}") for w in WEIGHTS])


@query()
def release_rule(spark, d):
    """Rows only: damped trend for 12 months, scaled season before origin 18, else the ridge; tested against its parts."""
    wide = pairs(spark, d)
    late = [(c, h) for c, h in B.CASES if c >= 18 and h != 12]
    fitted = ridge.forecasts(P.order_panel(spark, d), late).withColumnRenamed("predicted", "ridge")
    rule = F.when(F.col("h") == 12, F.col("damped_trend")).when(F.col("c") < 18, F.col("seasonal_scaled")).otherwise(F.col("ridge"))
    return wide.join(fitted, [*P.SERIES, "c", "h"], "left").select(*P.SERIES, "c", "h", tidy(rule, 2).alias("predicted"))


RIDGE_CASES = [(18, 1), (18, 3), (18, 12), (21, 1)]
RIDGE_SQL = f"""{FACTORS}, rc(c, h) AS (VALUES {', '.join(f'({c}, {h})' for c, h in RIDGE_CASES)}),
ls AS (SELECT territory_id, category, c, list(z ORDER BY t) AS xs, regr_slope(z, t) FILTER (WHERE t >= c - 6) AS slope FROM zs GROUP BY ALL)"""
RIDGE_COLUMNS = {
    "level": "xs[c]", "diff1": "xs[c - 1] - xs[c]", "diff2": "xs[c - 2] - xs[c]", "mean3": "list_avg(xs[c - 2:c]) - xs[c]", "mean6": "list_avg(xs[c - 5:c]) - xs[c]", "slope": "slope", "slope_h": "slope * least(h, 6)",
    "seasonal_diff": "xs[c + h - 12] - xs[c]", "yoy": "list_aggregate(list_transform(range(13, c + 1), lambda i: xs[i] - xs[i - 12]), 'median')", "h12": "h / 12.0", "log_h": "ln(1 + h)", "has_season": "CAST(1 AS DOUBLE)", "age": "c / 24.0",
}
WAVES = {f"{f}{k}": f"{f}({2 * k} * pi() * (c + h - 1) / 12)" for k in (1, 2) for f in ("sin", "cos")}
RIDGE_COLUMNS |= WAVES | {f"cat{i}": f"CASE WHEN code = {i} THEN 1.0 ELSE 0.0 END" for i in range(6)}
RIDGE_COLUMNS |= {f"cat{i}_{n}": f"CASE WHEN code = {i} THEN {x} ELSE 0.0 END" for i in range(6) for n, x in WAVES.items()}


@query(f"WITH {RIDGE_SQL} SELECT territory_id, category, c, h, {', '.join(f'{t(x, 6)} AS {n}' for n, x in RIDGE_COLUMNS.items())} FROM (SELECT *, dense_rank() OVER (ORDER BY category) - 1 AS code FROM ls) JOIN rc USING (c)")
def ridge_features(spark, d):
    panel = P.order_panel(spark, d)
    rows = ridge.feature_rows(panel, RIDGE_CASES, panel.select("category").distinct().count())
    return rows.select(*P.SERIES, "c", "h", *[tidy(n, 6).alias(n) for n in RIDGE_COLUMNS])


@query()
def news_ablation(spark, d):
    """Rows only: mean errors of the ridge without and with news, on the same pairs."""
    panel, cases = P.order_panel(spark, d), [(18, 1), (18, 3), (18, 6)]
    actual = panel.select(*P.SERIES, F.col("t").alias("target"), F.col("y").alias("actual"))
    without, known = ridge.forecasts(panel, cases).withColumnRenamed("predicted", "without"), ridge.forecasts(panel, cases, events=news.events(spark)).withColumnRenamed("predicted", "with_news")
    both = without.join(known, [*P.SERIES, "c", "h"]).withColumn("target", F.col("c") + F.col("h") - 1).join(actual, [*P.SERIES, "target"])
    return M.paired_change(both, "with_news", "without", "h")


@query()
def ridge_forecast(spark, d):
    """Rows only: fitted by pyspark.ml; parity with the closed form is tested."""
    return ridge.forecasts(P.order_panel(spark, d), [(18, 1), (18, 3), (21, 1)]).select(*P.SERIES, "c", "h", tidy("predicted", 2).alias("predicted"))


#: Short origins, each with its weights.
SHORT = [6, 9, 12]
SHORT_WEIGHTS = ", ".join(f"({c}, {t0}, CAST({w!r} AS DOUBLE))" for c in SHORT for t0, w in enumerate(A.trend_weights(list(range(c)))))


@query(f"""WITH {FACTORS.replace(f"o(c) AS (VALUES {', '.join(f'({c})' for c in ORIGINS)})", f"o(c) AS (VALUES {', '.join(f'({c})' for c in SHORT)})")}, ew(c, t, w) AS (VALUES {SHORT_WEIGHTS})
SELECT category, c, {t('least(greatest(sum(w * f), -0.2), 0.7)', 6)} AS growth FROM fs JOIN ew USING (c, t) GROUP BY ALL""")
def early_growth(spark, d):
    """The weights are tested against the penalised fit."""
    return A.early_growths(A.decomposed(P.order_panel(spark, d), SHORT), SHORT).withColumn("growth", tidy("growth", 6))


@query(f"WITH {BASE} SELECT territory_id, category, c, h, {t('CASE WHEN h = 12 THEN damped_trend ELSE seasonal_scaled END', 2)} AS predicted FROM paired WHERE h = 12 OR c < 18")
def release_rule_early(spark, d):
    """The rule where it takes no ridge."""
    return pairs(spark, d).where("h = 12 OR c < 18").select(*P.SERIES, "c", "h", tidy(F.when(F.col("h") == 12, F.col("damped_trend")).otherwise(F.col("seasonal_scaled")), 2).alias("predicted"))

"""Queries on change detection; folds have recursive SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import tidy
from ..operators import detectors as D
from ..operators import integrity, news
from ..operators import panel as P
from .ctes import DENSE, SUPPLIERS
from .ctes import tidy as t
from .forecasting import EVENTS
from .registry import query

MEDIAN = lambda x: f"list_aggregate({x}, 'median')"
MAD = lambda x, floor: f"greatest(1.4826 * list_aggregate(list_transform({x}, lambda q: abs(q - list_aggregate({x}, 'median'))), 'median'), {floor})"

INNOVATIONS = f"""{SUPPLIERS}, {DENSE}, x0 AS (SELECT *, ln(y + 1) AS x, ln(lag(y, 12) OVER (PARTITION BY territory_id, category ORDER BY t) + 1) AS x12 FROM dense),
x1 AS (SELECT *, list(CASE WHEN x IS NOT NULL THEN {{'t': t, 'x': x}} END) OVER w AS seen0, list(x - x12) OVER w AS ch0 FROM x0 WINDOW w AS (PARTITION BY territory_id, category ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x2 AS (SELECT *, list_filter(coalesce(seen0, []), lambda q: q IS NOT NULL) AS seen, list_filter(coalesce(ch0, []), lambda q: q IS NOT NULL) AS ch FROM x1),
x3 AS (SELECT *, len(seen) AS n, list_reverse(seen)[1:6] AS l6, list_reverse(ch)[1:6] AS c6 FROM x2),
x4 AS (SELECT *, list_sum(list_transform(l6, lambda q: q.t)) / len(l6) AS mt, list_sum(list_transform(l6, lambda q: q.x)) / len(l6) AS mx FROM x3),
x5 AS (SELECT *, CASE WHEN t >= 6 AND n >= 6 AND x IS NOT NULL THEN x - CASE WHEN x12 IS NOT NULL THEN x12 + coalesce({MEDIAN('c6')}, 0)
  ELSE l6[1].x + 0.8 * list_sum(list_transform(l6, lambda q: (q.t - mt) * (q.x - mx))) / list_sum(list_transform(l6, lambda q: (q.t - mt) * (q.t - mt))) * (t - l6[1].t) END END AS e FROM x4),
x6 AS (SELECT *, list_reverse(list_filter(coalesce(list(e) OVER (PARTITION BY territory_id, category ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []), lambda q: q IS NOT NULL))[1:12] AS es FROM x5),
zs AS (SELECT territory_id, category, t, CASE WHEN len(es) >= 6 AND e IS NOT NULL THEN least(greatest((e - {MEDIAN('es')}) / {MAD('es', 0.03)}, -12), 12) END AS z FROM x6)"""


@query(f"WITH {INNOVATIONS} SELECT territory_id, t, {t('z', 6)} AS z FROM zs")
def innovations_z(spark, d):
    return D.innovations(P.supplier_panel(spark, d)).select("territory_id", "t", tidy("z", 6).alias("z"))


def _chart(state: str, score: str, direction: str, empty: str, cooldown: int = 3) -> str:
    """A recursive fold over months; state is an expression of s (the state before) and z."""
    return f"""WITH RECURSIVE {INNOVATIONS}, fold AS (
  SELECT territory_id, -1 AS t, {empty} AS s, -1000 AS last, CAST(0 AS DOUBLE) AS score, FALSE AS alarm, 0 AS direction FROM (SELECT DISTINCT territory_id FROM zs)
  UNION ALL
  SELECT territory_id, t, CASE WHEN z IS NULL THEN s WHEN alarm THEN {empty} ELSE s2 END, CASE WHEN z IS NOT NULL AND alarm THEN t ELSE last END, CASE WHEN z IS NULL THEN 0 ELSE score END, z IS NOT NULL AND alarm, CASE WHEN z IS NULL THEN 0 ELSE direction END
  FROM (SELECT *, score >= 1 AND t - last > {cooldown} AS alarm FROM (SELECT *, {score} AS score, {direction} AS direction FROM (
    SELECT f.territory_id, n.t, f.s, f.last, n.z, {state} AS s2 FROM fold f JOIN zs n ON n.territory_id = f.territory_id AND n.t = f.t + 1)))
) SELECT territory_id, t, {t('score', 6)} AS score, score >= 0.7 AS warning, alarm, CAST(direction AS INTEGER) AS direction FROM fold WHERE t >= 0"""


def _charted(rows):
    return rows.select("territory_id", "t", tidy("score", 6).alias("score"), "warning", "alarm", "direction")


def _z(spark, d):
    return D.innovations(P.supplier_panel(spark, d))


@query(_chart("{'up': greatest(0, f.s.up + n.z - 0.5), 'down': greatest(0, f.s.down - n.z - 0.5)}", "greatest(s2.up, s2.down) / 4", "CASE WHEN s2.up >= s2.down THEN 1 ELSE -1 END", "{'up': CAST(0 AS DOUBLE), 'down': CAST(0 AS DOUBLE)}"))
def cusum(spark, d):
    return _charted(D.cusum(_z(spark, d), 4.0))


@query(_chart("{'up': greatest(0, f.s.up + n.z - 0.5), 'down': greatest(0, f.s.down - n.z - 0.5)}", "greatest(s2.up, s2.down) / 8", "CASE WHEN s2.up >= s2.down THEN 1 ELSE -1 END", "{'up': CAST(0 AS DOUBLE), 'down': CAST(0 AS DOUBLE)}"))
def cusum_v1(spark, d):
    return _charted(D.cusum(_z(spark, d), 8.0))


@query(_chart("0.3 * n.z + 0.7 * f.s", f"abs(s2) / {math.sqrt(0.3 / 1.7) * 2!r}", "sign(s2)", "CAST(0 AS DOUBLE)"))
def ewma(spark, d):
    return _charted(D.ewma(_z(spark, d), 2.0))


@query(_chart("list_append(f.s, n.z)[-3:]", "abs(list_sum(s2) / len(s2)) * sqrt(len(s2)) / 2", "sign(list_sum(s2))", "CAST([] AS DOUBLE[])"))
def window_mean(spark, d):
    return _charted(D.window_mean(_z(spark, d), 2.0))


CLIPPED = "list_append(f.s, least(greatest(n.z, -3), 3))[-6:]"
SCALES = f"[{', '.join(f'CASE WHEN len(s2) >= {k} THEN list_sum(s2[-{k}:]) / {math.sqrt(k)!r} ELSE 0 END' for k in range(2, 7))}]"


@query(_chart(CLIPPED, f"CASE WHEN len(s2) >= 3 THEN abs({MEDIAN('s2[-3:]')} * {math.sqrt(3)!r}) / 2 ELSE 0 END", f"CASE WHEN len(s2) >= 3 THEN sign({MEDIAN('s2[-3:]')}) ELSE 0 END", "CAST([] AS DOUBLE[])", 6))
def median3(spark, d):
    return _charted(D.robust(_z(spark, d), "median3", 2.0))


@query(_chart(CLIPPED, f"list_max(list_transform({SCALES}, lambda q: abs(q))) / 3", f"sign({SCALES}[list_position(list_transform({SCALES}, lambda q: abs(q)), list_max(list_transform({SCALES}, lambda q: abs(q))))])", "CAST([] AS DOUBLE[])", 6))
def multiscale(spark, d):
    return _charted(D.robust(_z(spark, d), "multiscale", 3.0))


PANEL_Z = f"""{SUPPLIERS}, yo AS (SELECT a.territory_id, a.category, a.t, ln(a.y + 1) - ln(b.y + 1) AS change FROM obs a JOIN obs b ON a.territory_id = b.territory_id AND a.category = b.category AND a.t = b.t + 12),
fa AS (SELECT t, median(change) AS factor FROM yo GROUP BY t), sp AS (SELECT t, any_value(factor) AS factor, greatest(1.4826 * median(abs(change - factor)), 0.02) AS spread FROM yo JOIN fa USING (t) GROUP BY t),
pz AS (SELECT territory_id, t, (change - factor) / spread AS z FROM yo JOIN sp USING (t)),
pw AS (SELECT territory_id, t, abs(avg(z) OVER w) AS score, count(z) OVER w AS k FROM pz WINDOW w AS (PARTITION BY territory_id ORDER BY t RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)),
hits AS (SELECT territory_id, t, row_number() OVER (PARTITION BY territory_id ORDER BY t) AS r FROM pw WHERE k = 2 AND score >= 1.5)"""


@query(f"WITH {PANEL_Z} SELECT territory_id, t, {t('z', 6)} AS z FROM pz")
def panel_z(spark, d):
    return D.panel_scores(P.supplier_panel(spark, d)).select("territory_id", "t", tidy("z", 6).alias("z"))


GREEDY = """greedy AS (SELECT territory_id, r, t, t AS last, TRUE AS kept FROM hits WHERE r = 1
  UNION ALL SELECT h.territory_id, h.r, h.t, CASE WHEN h.t - g.last > 3 THEN h.t ELSE g.last END, h.t - g.last > 3 FROM greedy g JOIN hits h ON h.territory_id = g.territory_id AND h.r = g.r + 1)"""


@query(f"WITH RECURSIVE {PANEL_Z}, {GREEDY} SELECT territory_id, t FROM greedy WHERE kept")
def panel_alarms(spark, d):
    z = D.panel_scores(P.supplier_panel(spark, d))
    return D.alarms(D.panel_window(z, 2), 1.5).select("territory_id", "t")


def _panel_alarms(w: int, threshold: float) -> None:
    def run(spark, d):
        return D.alarms(D.panel_window(D.panel_scores(P.supplier_panel(spark, d)), w), threshold).select("territory_id", "t")

    run.__name__ = f"panel{w}_alarms"
    sql = PANEL_Z.replace("RANGE BETWEEN 1 PRECEDING", f"RANGE BETWEEN {w - 1} PRECEDING").replace("k = 2 AND score >= 1.5", f"k = {w} AND score >= {threshold}")
    query(f"WITH RECURSIVE {sql}, {GREEDY} SELECT territory_id, t FROM greedy WHERE kept")(run)


_panel_alarms(1, 2.0)
_panel_alarms(3, 1.0)

CASE_EVENTS = [(1, 15, 16), (2, 15, 16), (3, 15, 17)]


@query(f"""WITH RECURSIVE {PANEL_Z}, {GREEDY}, ce(territory_id, event_t, available_t) AS (VALUES {", ".join(map(str, CASE_EVENTS))}), rg AS (SELECT territory_id, t, (change - factor) * 100 AS relative FROM yo JOIN fa USING (t))
SELECT ce.territory_id, event_t, available_t, coalesce((SELECT string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FROM greedy g WHERE kept AND g.territory_id = ce.territory_id AND g.t >= event_t), '') AS alarm_months,
  (SELECT {t("avg(relative) FILTER (WHERE t BETWEEN 15 AND 17) - avg(relative) FILTER (WHERE t BETWEEN 12 AND 14)", 6)} FROM rg WHERE rg.territory_id = ce.territory_id) AS relative_gap FROM ce""")
def case_study(spark, d):
    panel = P.supplier_panel(spark, d)
    events = spark.createDataFrame(CASE_EVENTS, "territory_id long, event_t int, available_t int")
    rows = integrity.case_study(panel, panel_alarms(spark, d), events, [12, 13, 14], [15, 16, 17])
    months = F.coalesce(F.array_join(F.transform("alarm_months", lambda m: m.cast("string")), ","), F.lit(""))
    return rows.select("territory_id", "event_t", "available_t", months.alias("alarm_months"), tidy("relative_gap", 6).alias("relative_gap"))


@query(f"""WITH {PANEL_Z}, ce(territory_id, event_t, available_t) AS (VALUES {", ".join(map(str, CASE_EVENTS))}), rg AS (SELECT territory_id, t, (change - factor) * 100 AS relative FROM yo JOIN fa USING (t))
SELECT ce.territory_id, event_t, o.t, {t('o.y')} AS actual, {t('relative', 6)} AS relative, available_t <= o.t AS news_known FROM ce JOIN obs o USING (territory_id) LEFT JOIN rg ON rg.territory_id = o.territory_id AND rg.t = o.t""")
def case_history(spark, d):
    events = spark.createDataFrame(CASE_EVENTS, "territory_id long, event_t int, available_t int")
    return integrity.case_history(P.supplier_panel(spark, d), {}, events).withColumns({"actual": tidy("actual"), "relative": tidy("relative", 6)})


UNIFORM = lambda *k: f"(CAST(('0x' || substr(md5({' || chr(58) || '.join(k)}), 1, 12)) AS BIGINT) / {float(1 << 48)!r})"
U = lambda name, lo, hi: f"{lo} + {hi - lo!r} * {UNIFORM('case_id', repr(name))}"


NOISE = f"sqrt(-2 * ln(1 - {UNIFORM('case_id', 't', repr('a'))})) * cos(2 * pi() * {UNIFORM('case_id', 't', repr('b'))})"
MADE = f"""exp(base + trend * t + season * sin(2 * pi() * t / 12 + phase) + sigma * {NOISE}
  + CASE WHEN kind = 'up' AND t >= at0 THEN size WHEN kind = 'down' AND t >= at0 THEN -size WHEN kind = 'slope' AND t >= at0 THEN (t - at0) * rise WHEN kind = 'outlier' AND t = at0 THEN 2 * size ELSE 0 END) - 1"""


@query(f"""WITH k AS (SELECT unnest(['none', 'outlier', 'up', 'down', 'slope']) AS kind), c AS (SELECT kind, 's-60-' || kind || '-' || id AS case_id FROM k, (SELECT unnest(range(0, 20)) AS id)),
p AS (SELECT *, 28 + CAST(floor({UNIFORM("case_id", "'at'")} * 15) AS INTEGER) AS at0, {U('sigma', 0.02, 0.07)} AS sigma, {U('base', 6.0, 10.0)} AS base, {U('trend', -0.002, 0.01)} AS trend, {U('season', 0.03, 0.16)} AS season, {U('phase', 0.0, 6.28)} AS phase,
  {U('size', 0.12, 0.35)} AS size, {U('rise', 0.015, 0.035)} AS rise FROM c), r AS (SELECT *, unnest(range(0, 60)) AS t FROM p)
SELECT case_id, kind, CASE WHEN kind NOT IN ('none', 'outlier') THEN at0 END AS change, CAST(t AS INTEGER) AS t, {t(MADE, 3)} AS y FROM r""")
def synthetic_cases(spark, d):
    return D.synthetic(spark, "s", 20).withColumn("y", tidy("y", 3))


@query()
def synthetic_scores(spark, d):
    """Rows only: charts on made series by method and threshold; the rules of choice are tested on their own."""
    return _synthetic_scores(spark).select("method", "threshold", "length", "tp", "fp", "fn", tidy("f1", 6).alias("f1"), tidy("control_rate", 6).alias("control_rate"), F.col("delay").cast("double").alias("delay"))


def _synthetic_scores(spark, cases: int = 20):
    out = None
    for length in (24, 60):
        made = D.synthetic(spark, "cal", cases, length)
        z = D.innovations(made.select(F.col("case_id").alias("territory_id"), F.lit("ALL").alias("category"), "t", "y"), length)
        listed = made.select("case_id", "kind", "change").distinct()
        for method, threshold, chart in (("cusum_v1", 8.0, D.cusum(z, 8.0)), *(("multiscale", x, D.robust(z, "multiscale", x)) for x in (3.0, 5.0))):
            found = chart.where("alarm").select(F.col("territory_id").alias("case_id"), "t")
            row = D.case_scores(listed, found, 6).withColumns({"method": F.lit(method), "threshold": F.lit(threshold), "length": F.lit(length)})
            out = row if out is None else out.unionByName(row)
    return out


def _confirmed_sql(source: str, keys: str, w: int) -> str:
    return f"""cx AS (SELECT *, ln(y + 1) AS x FROM {source}), cf AS (SELECT category, t, median(x) AS f FROM cx GROUP BY ALL),
c1 AS (SELECT cx.*, x - f AS r FROM cx JOIN cf USING (category, t)), c2 AS (SELECT *, r - lag(r) OVER (PARTITION BY {keys} ORDER BY t) AS diff FROM c1),
c3 AS (SELECT *, list_filter(coalesce(list(diff) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []), lambda q: q IS NOT NULL) AS diffs,
  list_filter(coalesce(list(r) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN {w + 5} PRECEDING AND {w} PRECEDING), []), lambda q: q IS NOT NULL) AS ref,
  list_filter(coalesce(list(r) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), []), lambda q: q IS NOT NULL) AS recent FROM c2),
c4 AS (SELECT *, list_transform(recent, lambda v: v - {MEDIAN('ref')}) AS shifts FROM c3),
confirmed AS (SELECT {keys}, t, CASE WHEN t >= 12 AND len(ref) = 6 AND len(recent) = {w} AND len(diffs) > 0 AND (list_min(shifts) > 0 OR list_max(shifts) < 0)
  THEN list_min(list_transform(shifts, lambda v: abs(v))) / {MAD('diffs', 0.015)} ELSE 0 END AS score FROM c4)"""


def _confirmed(w: int) -> None:
    def run(spark, d):
        return D.change_scores(P.supplier_panel(spark, d), w).select("territory_id", "t", tidy("score", 6).alias("score"))

    run.__name__ = f"confirmed{w}"
    query(f"WITH {SUPPLIERS}, {DENSE}, {_confirmed_sql('dense', 'territory_id, category', w)} SELECT territory_id, t, {t('score', 6)} AS score FROM confirmed")(run)


_confirmed(2)
_confirmed(3)

INJECTED = f"""{SUPPLIERS}, whole AS (SELECT * FROM obs WHERE territory_id IN (SELECT territory_id FROM obs GROUP BY 1 HAVING count(*) = 24)),
kinds AS (SELECT unnest(['control', 'level_up_10', 'level_up_20', 'level_down_10', 'level_down_20', 'slope_up', 'outlier']) AS kind),
i0 AS (SELECT *, CAST(CAST(('0x' || substr(md5('case:' || territory_id || ':' || category || ':' || kind), 1, 6)) AS BIGINT) % 5 + 15 AS INTEGER) AS at0 FROM whole, kinds),
inj AS (SELECT territory_id, category, kind, CASE WHEN kind NOT IN ('control', 'outlier') THEN at0 END AS change, t, y * CASE WHEN kind = 'level_up_10' AND t >= at0 THEN 1.1 WHEN kind = 'level_up_20' AND t >= at0 THEN 1.2
  WHEN kind = 'level_down_10' AND t >= at0 THEN 0.9 WHEN kind = 'level_down_20' AND t >= at0 THEN 0.8 WHEN kind = 'slope_up' AND t >= at0 THEN exp(0.03 * (t - at0 + 1)) WHEN kind = 'outlier' AND t = at0 THEN 1.3 ELSE 1 END AS y FROM i0)"""


def _cases(spark, d):
    return D.injected(P.complete(P.supplier_panel(spark, d)))


@query(f"WITH {INJECTED} SELECT territory_id, kind, change, t, {t('y', 3)} AS y FROM inj")
def inject_cases(spark, d):
    return _cases(spark, d).select("territory_id", "kind", "change", "t", tidy("y", 3).alias("y"))


#: The score of a case is against the factor of the untouched panel; threshold grid
GRID = (1.5, 2.0, 2.5, 3.0)
SCORED = f"""{INJECTED}, cy AS (SELECT i.territory_id, i.kind, i.change, i.t, ln(i.y + 1) - ln(b.y + 1) AS change12 FROM inj i JOIN inj b ON b.territory_id = i.territory_id AND b.kind = i.kind AND b.t = i.t - 12),
oy AS (SELECT a.territory_id, a.t, ln(a.y + 1) - ln(b.y + 1) AS ch FROM whole a JOIN whole b ON a.territory_id = b.territory_id AND a.t = b.t + 12), of1 AS (SELECT t, median(ch) AS factor FROM oy GROUP BY t),
os AS (SELECT t, any_value(factor) AS factor, greatest(1.4826 * median(abs(ch - factor)), 0.02) AS spread FROM oy JOIN of1 USING (t) GROUP BY t),
cz AS (SELECT territory_id, kind, change, t, abs((change12 - factor) / spread) AS score FROM cy JOIN os USING (t)),
th AS (SELECT unnest(CAST([{', '.join(map(str, GRID))}] AS DOUBLE[])) AS threshold),
hits AS (SELECT threshold, territory_id, kind, t, row_number() OVER (PARTITION BY threshold, territory_id, kind ORDER BY t) AS r FROM cz, th WHERE score >= threshold),
greedy AS (SELECT threshold, territory_id, kind, r, t, t AS last, TRUE AS kept FROM hits WHERE r = 1
  UNION ALL SELECT h.threshold, h.territory_id, h.kind, h.r, h.t, CASE WHEN h.t - g.last > 3 THEN h.t ELSE g.last END, h.t - g.last > 3 FROM greedy g JOIN hits h ON h.threshold = g.threshold AND h.territory_id = g.territory_id AND h.kind = g.kind AND h.r = g.r + 1),
cs AS (SELECT DISTINCT threshold, territory_id, kind, change FROM inj, th),
pc AS (SELECT c.threshold, c.territory_id, c.kind, c.change, count(g.t) AS alarms, min(CASE WHEN g.t BETWEEN c.change AND c.change + 2 THEN g.t END) AS first FROM cs c LEFT JOIN (SELECT * FROM greedy WHERE kept) g ON g.threshold = c.threshold AND g.territory_id = c.territory_id AND g.kind = c.kind GROUP BY ALL),
sums AS (SELECT threshold, CAST(count(first) AS BIGINT) AS tp, CAST(sum(alarms) - count(first) AS BIGINT) AS fp, CAST(count(change) - count(first) AS BIGINT) AS fn, avg(CASE WHEN kind = 'control' THEN CASE WHEN alarms > 0 THEN 1 ELSE 0 END END) AS control_rate, median(first - change) AS delay FROM pc GROUP BY threshold),
scores AS (SELECT threshold, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, control_rate, delay FROM sums)"""


def _case_id():
    return F.concat_ws(":", "territory_id", "kind").alias("case_id")


def _one_by_kind(spark, d):
    """The untouched panel, its cases as series of their own, and the list of cases."""
    whole, cases = P.complete(P.supplier_panel(spark, d)), _cases(spark, d)
    return whole, cases.withColumn("category", F.concat_ws(":", "category", "kind")), cases.select(_case_id(), "kind", "change").distinct()


def _case_z(whole, one):
    reference = D.factor_and_spread(whole).drop("category")
    return D.yearly(one).join(F.broadcast(reference), "t").select(*P.SERIES, "t", ((F.col("change") - F.col("factor")) / F.col("spread")).alias("z"))  # a row for each month


def _by_case(found, *more):
    return found.withColumn("kind", F.substring_index("category", ":", -1)).select(_case_id(), "t", *more)


def _at(listed, thresholds):
    return listed.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))


def _scores(spark, d):
    whole, one, listed = _one_by_kind(spark, d)
    z = _case_z(whole, one).select(*P.SERIES, "t", F.abs("z").alias("score"))
    return D.case_scores(_at(listed, GRID), _by_case(D.alarms_at(z, GRID), "threshold"), by=("threshold",))


@query(f"""WITH RECURSIVE {SCORED} SELECT threshold, tp, fp, fn, {t('"precision"', 6)} AS "precision", {t('recall', 6)} AS recall, {t('f1', 6)} AS f1, {t('control_rate', 6)} AS control_rate, CAST(delay AS DOUBLE) AS delay FROM scores""")
def detector_scores(spark, d):
    return _scores(spark, d).select("threshold", "tp", "fp", "fn", *[tidy(c, 6).alias(c) for c in ("precision", "recall", "f1", "control_rate")], F.col("delay").cast("double").alias("delay"))


@query(f"""WITH RECURSIVE {SCORED} SELECT threshold, {t('f1', 6)} AS f1, {t('control_rate', 6)} AS control_rate FROM scores
ORDER BY control_rate > 0.05, CASE WHEN control_rate <= 0.05 THEN -f1 ELSE control_rate END, CASE WHEN control_rate <= 0.05 THEN threshold ELSE -f1 END, threshold LIMIT 1""")
def threshold_choice(spark, d):
    return D.chosen(_scores(spark, d).select("threshold", "f1", "control_rate")).select("threshold", tidy("f1", 6).alias("f1"), tidy("control_rate", 6).alias("control_rate"))


@query(f"""WITH RECURSIVE {PANEL_Z}, {GREEDY}, {EVENTS}, al AS (SELECT territory_id, t, CAST(make_date(1999 + t // 12, t % 12 + 1, 1) + INTERVAL 1 MONTH AS DATE) AS as_of FROM greedy WHERE kept)
SELECT territory_id, t, as_of, coalesce((SELECT string_agg(event_id, ';' ORDER BY event_id) FROM ev WHERE delta <> 0 AND available < al.as_of AND available >= al.as_of - 90), '') AS known_news_ids FROM al""")
def signals_with_news(spark, d):
    found = panel_alarms(spark, d).withColumn("as_of", F.add_months(F.make_date(F.lit(1999), F.lit(1), F.lit(1)), F.col("t") + 1))
    return news.around(found, news.events(spark)).select("territory_id", "t", "as_of", "known_news_ids")


@query(f"WITH RECURSIVE {PANEL_Z}, {GREEDY} SELECT territory_id, max(t) AS t, count(*) AS alarms FROM greedy WHERE kept GROUP BY 1")
def latest_signal(spark, d):
    return panel_alarms(spark, d).groupBy("territory_id").agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("alarms"))


#: Thresholds that the scores of confirmed shifts are tried at.
SHIFT_GRID = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0)


def _sums(rows: str, by: str) -> str:
    return f"""sums AS (SELECT {by}, CAST(count(first) AS BIGINT) AS tp, CAST(sum(alarms) - count(first) AS BIGINT) AS fp, CAST(count(change) - count(first) AS BIGINT) AS fn, avg(CASE WHEN kind = 'control' THEN CASE WHEN alarms > 0 THEN 1 ELSE 0 END END) AS control_rate, median(first - change) AS delay FROM {rows} GROUP BY ALL),
scores AS (SELECT {by}, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, control_rate, delay FROM sums)"""


SHOWN_SCORES = f"""tp, fp, fn, {t('"precision"', 6)} AS "precision", {t('recall', 6)} AS recall, {t('f1', 6)} AS f1, {t('control_rate', 6)} AS control_rate, CAST(delay AS DOUBLE) AS delay"""


def _shown_scores(rows, *by):
    return rows.select(*by, "tp", "fp", "fn", *[tidy(c, 6).alias(c) for c in ("precision", "recall", "f1", "control_rate")], F.col("delay").cast("double").alias("delay"))


def _shift_sql(w: int) -> str:
    scored = _confirmed_sql("inj", "territory_id, kind", w).replace("cf AS (SELECT category, t, median(x) AS f FROM cx GROUP BY ALL)", "cf AS (SELECT t, median(ln(y + 1)) AS f FROM whole GROUP BY ALL)").replace("FROM cx JOIN cf USING (category, t)", "FROM cx JOIN cf USING (t)")
    return f"""SELECT 'confirmed{w}' AS method, * FROM (WITH RECURSIVE {INJECTED}, {scored}, th AS (SELECT unnest(CAST([{', '.join(map(str, SHIFT_GRID))}] AS DOUBLE[])) AS threshold),
hits AS (SELECT threshold, territory_id, kind, t, row_number() OVER (PARTITION BY threshold, territory_id, kind ORDER BY t) AS r FROM confirmed, th WHERE score >= threshold),
greedy AS (SELECT threshold, territory_id, kind, r, t, t AS last, TRUE AS kept FROM hits WHERE r = 1
  UNION ALL SELECT h.threshold, h.territory_id, h.kind, h.r, h.t, CASE WHEN h.t - g.last > 3 THEN h.t ELSE g.last END, h.t - g.last > 3 FROM greedy g JOIN hits h ON h.threshold = g.threshold AND h.territory_id = g.territory_id AND h.kind = g.kind AND h.r = g.r + 1),
cs AS (SELECT DISTINCT threshold, territory_id, kind, change FROM inj, th),
pc AS (SELECT c.threshold, c.territory_id, c.kind, c.change, count(g.t) AS alarms, min(CASE WHEN g.t BETWEEN c.change AND c.change + 2 THEN g.t END) AS first FROM cs c LEFT JOIN (SELECT * FROM greedy WHERE kept) g ON g.threshold = c.threshold AND g.territory_id = c.territory_id AND g.kind = c.kind GROUP BY ALL),
{_sums('pc', 'threshold')} SELECT * FROM scores)"""


def _shift_scores(spark, d):
    whole, one, listed = _one_by_kind(spark, d)
    factor = whole.groupBy("t").agg(F.median(F.log(F.col("y") + 1)).alias("f"))
    out = None
    for w in (2, 3):
        found = _by_case(D.alarms_at(D.change_scores(one, w, factor=factor), SHIFT_GRID), "threshold")
        rows = D.case_scores(_at(listed, SHIFT_GRID), found, by=("threshold",)).withColumn("method", F.lit(f"confirmed{w}"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH scores AS ({_shift_sql(2)} UNION ALL {_shift_sql(3)}) SELECT method, threshold, {SHOWN_SCORES} FROM scores")
def shift_scores(spark, d):
    """Confirmed shifts on the cases of every complete series, against the untouched panel's factor."""
    return _shown_scores(_shift_scores(spark, d), "method", "threshold")


@query(f"""WITH scores AS ({_shift_sql(2)} UNION ALL {_shift_sql(3)}) SELECT method, threshold, {t('f1', 6)} AS f1, {t('control_rate', 6)} AS control_rate FROM scores
QUALIFY row_number() OVER (PARTITION BY method ORDER BY control_rate > 0.05, CASE WHEN control_rate <= 0.05 THEN -f1 ELSE control_rate END, control_rate, threshold) = 1""")
def shift_threshold(spark, d):
    return D.chosen_quiet(_shift_scores(spark, d).select("method", "threshold", "f1", "control_rate"), "method").select("method", "threshold", tidy("f1", 6).alias("f1"), tidy("control_rate", 6).alias("control_rate"))


@query(f"""WITH scores AS ({_shift_sql(2)} UNION ALL {_shift_sql(3)}) SELECT method, threshold, {t('f1', 6)} AS f1, {t('control_rate', 6)} AS control_rate FROM scores
QUALIFY row_number() OVER (PARTITION BY method ORDER BY f1 DESC, control_rate, threshold DESC) = 1""")
def threshold_by_f1(spark, d):
    return D.chosen_by_f1(_shift_scores(spark, d).select("method", "threshold", "f1", "control_rate"), "method").select("method", "threshold", tidy("f1", 6).alias("f1"), tidy("control_rate", 6).alias("control_rate"))


@query(f"""WITH scores AS ({_shift_sql(2)} UNION ALL {_shift_sql(3)}), per AS (SELECT method, threshold, avg(f1) AS f1, max(control_rate) AS control_rate FROM scores GROUP BY ALL)
SELECT method, threshold, {t('f1', 6)} AS f1, {t('control_rate', 6)} AS control_rate FROM per
ORDER BY control_rate > 0.1, CASE WHEN control_rate <= 0.1 THEN -f1 ELSE control_rate END, CASE WHEN control_rate <= 0.1 THEN 0 ELSE -f1 END, method, threshold LIMIT 1""")
def method_choice(spark, d):
    return D.chosen_across(_shift_scores(spark, d)).select("method", "threshold", tidy("f1", 6).alias("f1"), tidy("control_rate", 6).alias("control_rate"))


CASE_Z = f"""{INJECTED}, oy AS (SELECT a.territory_id, a.t, ln(a.y + 1) - ln(b.y + 1) AS ch FROM whole a JOIN whole b ON a.territory_id = b.territory_id AND a.t = b.t + 12), of1 AS (SELECT t, median(ch) AS factor FROM oy GROUP BY t),
os AS (SELECT t, any_value(factor) AS factor, greatest(1.4826 * median(abs(ch - factor)), 0.02) AS spread FROM oy JOIN of1 USING (t) GROUP BY t),
zs AS (SELECT i.territory_id || ':' || i.kind AS territory_id, i.t, (ln(i.y + 1) - ln(b.y + 1) - factor) / spread AS z FROM inj i LEFT JOIN inj b ON b.territory_id = i.territory_id AND b.kind = i.kind AND b.t = i.t - 12 LEFT JOIN os ON os.t = i.t)"""
CUSUM_STATE = ("{'up': greatest(0, f.s.up + n.z - 0.5), 'down': greatest(0, f.s.down - n.z - 0.5)}", "CASE WHEN s2.up >= s2.down THEN 1 ELSE -1 END", "{'up': CAST(0 AS DOUBLE), 'down': CAST(0 AS DOUBLE)}")
CUSUM8 = _chart(CUSUM_STATE[0], "greatest(s2.up, s2.down) / 8", CUSUM_STATE[1], CUSUM_STATE[2])
MULTI5 = _chart(CLIPPED, f"list_max(list_transform({SCALES}, lambda q: abs(q))) / 5", "1", "CAST([] AS DOUBLE[])", 6)


@query(f"""WITH found AS ({" UNION ALL ".join(f"SELECT '{m}' AS method, territory_id, t FROM ({sql.replace(INNOVATIONS, CASE_Z)}) WHERE alarm" for m, sql in (("cusum_v1", CUSUM8), ("multiscale", MULTI5)))}),
cs AS (SELECT DISTINCT method, territory_id || ':' || kind AS territory_id, kind, change FROM (WITH {INJECTED} SELECT * FROM inj), (SELECT unnest(['cusum_v1', 'multiscale']) AS method)),
pc AS (SELECT c.method, c.territory_id, c.kind, c.change, count(g.t) AS alarms, min(CASE WHEN g.t BETWEEN c.change AND c.change + 2 THEN g.t END) AS first FROM cs c LEFT JOIN found g ON g.method = c.method AND g.territory_id = c.territory_id GROUP BY ALL),
{_sums('pc', 'method')} SELECT method, {SHOWN_SCORES} FROM scores""")
def chart_scores(spark, d):
    whole, one, listed = _one_by_kind(spark, d)
    z = _case_z(whole, one)
    found = None
    for method, chart in (("cusum_v1", D.cusum(z, 8.0)), ("multiscale", D.robust(z, "multiscale", 5.0))):
        rows = _by_case(chart.where("alarm")).withColumn("method", F.lit(method))
        found = rows if found is None else found.unionByName(rows)
    asked = listed.withColumn("method", F.explode(F.array(F.lit("cusum_v1"), F.lit("multiscale"))))
    return _shown_scores(D.case_scores(asked, found, by=("method",)), "method")


CUSUM4 = _chart(CUSUM_STATE[0], "greatest(s2.up, s2.down) / 4", CUSUM_STATE[1], CUSUM_STATE[2])


@query(f"""WITH {EVENTS}, signals AS (SELECT *, CAST(make_date(1999 + t // 12, t % 12 + 1, 1) + INTERVAL 1 MONTH AS DATE) AS as_of FROM ({CUSUM4}) WHERE alarm OR warning)
SELECT territory_id, t, as_of, score, warning, alarm, direction, coalesce((SELECT string_agg(event_id, ';' ORDER BY event_id) FROM ev WHERE delta <> 0 AND available < signals.as_of AND available >= signals.as_of - 90), '') AS known_news_ids FROM signals""")
def signals_export(spark, d):
    """Alarms and warnings with their score, and the news known in the ninety days before."""
    found = _charted(D.cusum(_z(spark, d), 4.0)).where("alarm OR warning").withColumn("as_of", F.add_months(F.make_date(F.lit(1999), F.lit(1), F.lit(1)), F.col("t") + 1))
    return news.around(found, news.events(spark)).select("territory_id", "t", "as_of", "score", "warning", "alarm", "direction", "known_news_ids")


@query(f"SELECT territory_id, score, warning, alarm, direction FROM ({CUSUM4}) WHERE t = 23")
def latest_scores(spark, d):
    return _charted(D.cusum(_z(spark, d), 4.0)).where("t = 23").drop("t")


def _stream_sql(state: str, score: str, direction: str, empty: str) -> str:
    """The fold over a key's hours in order, numbered by r."""
    return f"""WITH RECURSIVE e AS (SELECT event_type AS key, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS t, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT key, t, n, row_number() OVER (PARTITION BY key ORDER BY t) AS r, count(*) OVER w AS seen, avg(n) OVER w AS mean, stddev_pop(n) OVER w AS sd FROM e WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
zs AS (SELECT key, t, r, CASE WHEN seen >= 12 THEN (n - mean) / greatest(sd, 1e-9) END AS z FROM m),
fold AS (
  SELECT key, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS r, {empty} AS s, CAST(-1000 AS BIGINT) AS last, CAST(0 AS DOUBLE) AS score, FALSE AS alarm, 0 AS direction FROM (SELECT DISTINCT key FROM zs)
  UNION ALL
  SELECT key, t, r, CASE WHEN z IS NULL THEN s WHEN alarm THEN {empty} ELSE s2 END, CASE WHEN z IS NOT NULL AND alarm THEN t ELSE last END, CASE WHEN z IS NULL THEN 0 ELSE score END, z IS NOT NULL AND alarm, CASE WHEN z IS NULL THEN 0 ELSE direction END
  FROM (SELECT *, score >= 1 AND t - last > 3 AS alarm FROM (SELECT *, {score} AS score, {direction} AS direction FROM (
    SELECT f.key, n.t, n.r, f.s, f.last, n.z, {state} AS s2 FROM fold f JOIN zs n ON n.key = f.key AND n.r = f.r + 1)))
) SELECT key, t, {t('score', 6)} AS score, score >= 0.7 AS warning, alarm, CAST(direction AS INTEGER) AS direction FROM fold WHERE r > 0"""


def _stream(name: str, method: str, threshold: float, sql: str) -> None:
    def run(spark, d):
        from ..streaming.charts import event_counts, replayed

        return replayed(spark, event_counts(spark, d), method=method, threshold=threshold).withColumn("score", tidy("score", 6))

    run.__name__ = name
    query(sql)(run)


_stream("streaming_cusum", "cusum", 4.0, _stream_sql(CUSUM_STATE[0], "greatest(s2.up, s2.down) / 4", CUSUM_STATE[1], CUSUM_STATE[2]))
_stream("streaming_ewma", "ewma", 2.0, _stream_sql("0.3 * n.z + 0.7 * f.s", f"abs(s2) / {math.sqrt(0.3 / 1.7) * 2!r}", "sign(s2)", "CAST(0 AS DOUBLE)"))
_stream("streaming_window_mean", "window_mean", 2.0, _stream_sql("list_append(f.s, n.z)[-3:]", "abs(list_sum(s2) / len(s2)) * sqrt(len(s2)) / 2", "sign(list_sum(s2))", "CAST([] AS DOUBLE[])"))
_stream("streaming_median3", "median3", 2.0, _stream_sql(CLIPPED, f"CASE WHEN len(s2) >= 3 THEN abs({MEDIAN('s2[-3:]')} * {math.sqrt(3)!r}) / 2 ELSE 0 END", f"CASE WHEN len(s2) >= 3 THEN sign({MEDIAN('s2[-3:]')}) ELSE 0 END", "CAST([] AS DOUBLE[])").replace("t - last > 3", "t - last > 6"))

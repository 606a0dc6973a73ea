"""Queries on the chain of forecasts v2, v3, v4, v5, with their SQL; each step's SQL is the text before and one more relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tidy
from ..operators import baselines as B
from ..operators import chain as C
from ..operators import factors as A
from ..operators import national as N
from ..operators import panel as P
from ..operators import ridge
from .ctes import BASE
from .ctes import tidy as t
from .forecasting import CASES, FACTORS, FIELDS, MEMBERS, RECENT, VALUE, _growth_sql, _levels
from .registry import query
from .relational import pairs

#: Policies are chosen on the pairs of the origins up to this one.
TUNED = 15
KEY = "territory_id, category, c, h"


def _names(names: list[str]) -> str:
    return ", ".join(names)


def _pick(names: list[str]) -> str:
    return f"CASE coalesce(model, '{names[0]}') " + " ".join(f"WHEN '{n}' THEN {n}" for n in names) + " END"


def _policy_sql(rows: str, names: list[str], into: str) -> str:
    place = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    return f"""{into}_e AS (SELECT h, category, name, avg(abs(v - actual)) AS mae FROM (UNPIVOT (SELECT h, category, c, actual, {_names(names)} FROM {rows}) ON {_names(names)} INTO NAME name VALUE v) WHERE c <= {TUNED} GROUP BY ALL),
{into} AS (SELECT h, category, CASE WHEN h <> 12 AND min(mae) <= 0.98 * max(mae) FILTER (WHERE name = '{names[0]}') THEN arg_min(name, (mae, list_position({place}, name))) ELSE '{names[0]}' END AS model, min(mae) AS best_mae, max(mae) FILTER (WHERE name = '{names[0]}') AS base_mae FROM {into}_e GROUP BY h, category)"""


ADAPTED = f"""ad AS (SELECT territory_id, category, c, h, greatest(least(greatest(raw, 0.25 * y), 4 * y), 0) AS adapted FROM (WITH {FACTORS},
  line AS (SELECT territory_id, category, c, regr_slope(z, t) AS slope, avg(z) AS mean FROM zs WHERE t < 12 GROUP BY ALL), xs AS (SELECT territory_id, category, c, list(z ORDER BY t) AS x FROM zs GROUP BY ALL)
  SELECT territory_id, category, c, h, exp(x[c]) - 1 AS y, exp(x[c] - (x[(c - 1) % 12 + 1] - mean - slope * ((c - 1) % 12 - 5.5)) + x[(c + h - 1) % 12 + 1] - mean - slope * ((c + h - 1) % 12 - 5.5)) - 1 AS raw
  FROM xs JOIN line USING (territory_id, category, c) JOIN fc USING (c)))"""
V2C = f"""{ADAPTED}, b AS (SELECT * FROM (WITH {BASE} SELECT * FROM paired)),
v2c AS (SELECT b.*, adapted, {', '.join(f'{w} * damped_trend + {1 - w} * seasonal_scaled AS blend_{int(100 * w)}' for w in C.WEIGHTS)}, 0.25 * adapted + 0.75 * seasonal_scaled AS adapted_mix FROM b JOIN ad USING ({KEY}))"""
V2 = f"""{V2C}, {_policy_sql('v2c', C.V2_NAMES, 'v2p')}, v2 AS (SELECT v2c.*, CASE WHEN h = 12 THEN damped_trend ELSE {_pick(C.V2_NAMES)} END AS v2 FROM v2c LEFT JOIN v2p USING (h, category))"""
COMMON = f"""pk AS (SELECT * FROM (WITH {FACTORS}, {_growth_sql(3)}, {_growth_sql(6)}, l AS (SELECT territory_id, category, c, median(d) AS l FROM ds WHERE t >= c - 3 GROUP BY ALL)
  SELECT l.territory_id, l.category, l.c, fc.h, {VALUE('fs.f + g3.g + l')} AS k3, {VALUE('fs.f + g6.g + l')} AS k6 FROM l JOIN g3 USING (category, c) JOIN g6 USING (category, c) JOIN fc USING (c) JOIN fs ON fs.category = l.category AND fs.c = l.c AND fs.t = l.c + fc.h - 13))"""
V3C = f"""{V2}, {COMMON}, v3m AS (SELECT v2.*, {', '.join(f'{w} * k{k} + {1 - w} * seasonal_scaled AS panel_k{k}_w{int(100 * w)}' for k in (3, 6) for w in (0.25, 0.75))} FROM v2 JOIN pk USING ({KEY})),
v3c AS (SELECT *, (v2 + panel_k3_w75) / 2 AS v2_panel_k3, (v2 + panel_k6_w75) / 2 AS v2_panel_k6 FROM v3m)"""
V3 = f"""{V3C}, {_policy_sql('v3c', C.V3_NAMES, 'v3p')}, v3 AS (SELECT v3c.*, {_pick(C.V3_NAMES)} AS v3 FROM v3c LEFT JOIN v3p USING (h, category))"""
MIX = f"""ml AS (SELECT {KEY}, target, actual, model, predicted FROM (UNPIVOT (SELECT m.*, target, actual FROM (SELECT * FROM (WITH {MEMBERS} SELECT {KEY}, {_names(C.MIXED)} FROM mem)) m
    JOIN (SELECT * FROM (WITH {BASE} SELECT {KEY}, target, actual FROM paired)) a USING ({KEY})) ON {_names(C.MIXED)} INTO NAME model VALUE predicted)),
losses AS (SELECT category, h, model, c AS origin, target, avg(abs(predicted - actual)) AS loss FROM ml GROUP BY ALL), asked AS (SELECT DISTINCT category, h, model, c FROM ml),
lj AS (SELECT a.*, CASE WHEN l.target < a.c THEN l.loss END AS loss, CASE WHEN l.target < a.c THEN l.target END AS seen_target FROM asked a LEFT JOIN losses l USING (category, h, model)),
lr AS (SELECT *, row_number() OVER (PARTITION BY category, h, model, c ORDER BY seen_target DESC NULLS LAST) AS r FROM lj),
lw AS (SELECT category, h, model, c, CASE WHEN count(loss) < 3 THEN 1.0 ELSE 1 / pow(greatest(avg(loss), 1), 2) END AS w FROM lr WHERE r <= 6 GROUP BY ALL),
weights AS (SELECT category, h, model, c, w / sum(w) OVER (PARTITION BY category, h, c) AS weight FROM lw),
mixed AS (SELECT {KEY}, sum(weight * predicted) AS online_mix FROM ml JOIN weights USING (category, h, model, c) GROUP BY ALL)"""
V4 = f"""{V3}, {MIX}, one AS (SELECT v3.*, online_mix FROM v3 JOIN mixed USING ({KEY}) WHERE h = 1),
gl AS (SELECT category, c, avg(abs(v3 - actual)) AS lb, avg(abs(online_mix - actual)) AS lm FROM one GROUP BY ALL),
gate AS (SELECT category, c, coalesce(count(lb) OVER w >= 3 AND avg(lm) OVER w <= 0.98 * avg(lb) OVER w, FALSE) AS open FROM gl WINDOW w AS (PARTITION BY category ORDER BY c ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
safe AS (SELECT one.*, open, CASE WHEN open THEN (v3 + online_mix) / 2 ELSE v3 END AS safe FROM one JOIN gate USING (category, c)),
v4 AS (SELECT v3.territory_id, v3.category, v3.c, v3.h, coalesce(safe, v3.v3) AS v4 FROM v3 LEFT JOIN safe USING ({KEY}))"""
V5 = f"""{V4}, lv5 AS (SELECT * FROM (WITH {_levels(1)}, {RECENT} SELECT l.territory_id, l.category, l.c, l.h, level3, local_blend, panel_recent FROM levels l LEFT JOIN recent USING ({KEY})))"""


def _v2c(spark, d, cases=CASES):
    return C.v2_candidates(pairs(spark, d).join(C.adapted_last(P.order_panel(spark, d), cases), C.KEYS))


def _v2(spark, d):
    rows = _v2c(spark, d)
    return C.chosen_value(rows, C.policy_of(rows, C.V2_NAMES, TUNED), C.V2_NAMES, "v2", "damped_trend")


def _v3c(spark, d):
    return C.v3_candidates(_v2(spark, d), C.common_parts(P.order_panel(spark, d), CASES))


def _v3(spark, d):
    rows = _v3c(spark, d)
    return C.chosen_value(rows, C.policy_of(rows, C.V3_NAMES, TUNED), C.V3_NAMES, "v3")


def _members(spark, d):
    actual = pairs(spark, d).select(*C.KEYS, "target", "actual")
    return A.members(P.order_panel(spark, d), CASES).join(actual, C.KEYS).unpivot([*C.KEYS, "target", "actual"], C.MIXED, "model", "predicted")


def _safe(spark, d, v3):
    one = v3.where("h = 1").join(A.online_mix(_members(spark, d)).select(*C.KEYS, "online_mix"), C.KEYS)
    return A.safe_mix(one, "v3", "online_mix")


def _v4(spark, d):
    v3 = _v3(spark, d)
    return v3.join(_safe(spark, d, v3).select(*C.KEYS, "safe"), C.KEYS, "left").select(*C.KEYS, F.coalesce("safe", "v3").alias("v4"))


def _shown(rows, names):
    return rows.select(*C.KEYS, *[tidy(n, 3).alias(n) for n in names])


@query(f"WITH {ADAPTED} SELECT {KEY}, {t('adapted', 3)} AS predicted FROM ad")
def season_adapted(spark, d):
    return C.adapted_last(P.order_panel(spark, d), CASES).select(*C.KEYS, tidy("adapted", 3).alias("predicted"))


@query(f"WITH {V2C} SELECT {KEY}, {', '.join(f'{t(n, 3)} AS {n}' for n in C.V2_NAMES)} FROM v2c")
def v2_candidates(spark, d):
    return _shown(_v2c(spark, d), C.V2_NAMES)


@query(f"WITH {V2} SELECT h, category, model, {t('best_mae')} AS best_mae, {t('base_mae')} AS base_mae FROM v2p")
def v2_policy(spark, d):
    return C.policy_of(_v2c(spark, d), C.V2_NAMES, TUNED).withColumns({c: tidy(c) for c in ("best_mae", "base_mae")})


@query(f"WITH {V2} SELECT {KEY}, {t('v2', 3)} AS v2 FROM v2")
def v2_forecast(spark, d):
    return _shown(_v2(spark, d), ["v2"])


@query()
def v2_with_ridge(spark, d):
    """Rows only: the candidates with the fitted ridge in place of the damped trend."""
    late = [(c, h) for c, h in CASES if c >= 18]
    fitted = ridge.forecasts(P.order_panel(spark, d), late).withColumnRenamed("predicted", "ridge")
    wide = pairs(spark, d).join(C.adapted_last(P.order_panel(spark, d), late), C.KEYS).join(fitted, C.KEYS)
    return _shown(C.v2_candidates(wide, "ridge"), C.V2_NAMES)


@query(f"WITH {V3C} SELECT {KEY}, {', '.join(f'{t(n, 3)} AS {n}' for n in C.V3_NAMES)} FROM v3c")
def v3_candidates(spark, d):
    return _shown(_v3c(spark, d), C.V3_NAMES)


@query(f"WITH {V3} SELECT h, category, model, {t('best_mae')} AS best_mae, {t('base_mae')} AS base_mae FROM v3p")
def v3_policy(spark, d):
    return C.policy_of(_v3c(spark, d), C.V3_NAMES, TUNED).withColumns({c: tidy(c) for c in ("best_mae", "base_mae")})


@query(f"WITH {V3} SELECT {KEY}, {t('v3', 3)} AS v3 FROM v3")
def v3_forecast(spark, d):
    return _shown(_v3(spark, d), ["v3"])


@query(f"WITH {MIX} SELECT category, h, c, model, {t('weight', 8)} AS weight FROM weights")
def mixture_weights(spark, d):
    return A.mixture(_members(spark, d)).withColumn("weight", tidy("weight", 8))


@query(f"WITH {MIX} SELECT {KEY}, {t('online_mix', 3)} AS online_mix FROM mixed")
def online_mix(spark, d):
    return _shown(A.online_mix(_members(spark, d)), ["online_mix"])


@query(f"WITH {V4} SELECT {KEY}, open, {t('safe', 3)} AS safe FROM safe")
def safe_mix(spark, d):
    return _safe(spark, d, _v3(spark, d)).select(*C.KEYS, "open", tidy("safe", 3).alias("safe"))


@query(f"WITH {V4} SELECT {KEY}, {t('v4', 3)} AS v4 FROM v4")
def v4_forecast(spark, d):
    return _shown(_v4(spark, d), ["v4"])


@query(f"""WITH {V5} SELECT {KEY}, {t("CASE WHEN h = 12 THEN level3 WHEN h IN (3, 6) THEN v4 ELSE (v4 + coalesce(panel_recent, local_blend) + local_blend) / 3 END", 3)} AS final FROM v4 JOIN lv5 USING ({KEY})""")
def v5_forecast(spark, d):
    panel = P.order_panel(spark, d)
    parts = N.level_forecasts(panel, N.national(spark, d), CASES, 1, FIELDS).join(N.panel_recent(panel, CASES), C.KEYS, "left")
    return _shown(N.combined(_v4(spark, d).join(parts, C.KEYS), "v4"), ["final"])


@query()
def boosted_factor(spark, d):
    """Rows only: boosted trees are an approximation; tested for repeatability and bounds."""
    from ..operators.adapters import boosted

    return _shown(boosted(P.order_panel(spark, d), 18, [h for c, h in B.CASES if c == 18]), ["factor_boost"])

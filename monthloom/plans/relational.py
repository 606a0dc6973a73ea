"""Queries on panels, baselines, metrics, cohorts, policies and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tidy
from ..operators import baselines as B
from ..operators import cohorts as C
from ..operators import metrics as M
from ..operators import panel as P
from ..operators import policy as Q
from .ctes import BASE, DENSE, ERRORS, OBS, SUPPLIERS
from .ctes import tidy as t
from .registry import query


@query(f"WITH {OBS} SELECT territory_id, category, t, {t('y')} AS y FROM obs")
def panel_long(spark, d):
    return P.order_panel(spark, d).select("territory_id", "category", "t", tidy("y").alias("y"))


@query(f"WITH {OBS}, {DENSE} SELECT territory_id, category, t, {t('y')} AS y FROM dense")
def panel_dense_calendar(spark, d):
    return P.dense(P.order_panel(spark, d)).select("territory_id", "category", "t", tidy("y").alias("y"))


@query("""SELECT CAST(sum(CASE WHEN o_custkey IS NULL OR o_orderpriority IS NULL OR o_totalprice IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY strftime(o_orderdate, '%Y-%m'), o_custkey, o_orderpriority)) AS duplicates,
  CAST(sum(CASE WHEN isnan(o_totalprice) OR isinf(o_totalprice) THEN 1 ELSE 0 END) AS BIGINT) AS not_finite, CAST(sum(CASE WHEN o_totalprice < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
  CAST(sum(CASE WHEN regexp_full_match(strftime(o_orderdate, '%Y-%m'), '[0-9]{4}-(0[1-9]|1[0-2])') THEN 0 ELSE 1 END) AS BIGINT) AS bad_dates FROM orders""")
def panel_expectations(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM").alias("date"), F.col("o_custkey").alias("territory_id"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("y"))
    return P.expectations(rows).select(*[F.col(c).cast("long").alias(c) for c in ("nulls", "duplicates", "not_finite", "negative", "bad_dates")])


@query(f"""WITH {OBS}, {DENSE} SELECT territory_id, category, t, {t("coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY territory_id, category ORDER BY t), avg(y) OVER (PARTITION BY territory_id, category))")} AS z
FROM dense WHERE t < 18""".replace("avg(y) OVER (PARTITION BY territory_id, category)", "(SELECT avg(o.y) FROM obs o WHERE o.territory_id = dense.territory_id AND o.category = dense.category AND o.t < 18)").replace("FROM dense WHERE t < 18", "FROM dense SEMI JOIN (SELECT DISTINCT territory_id, category FROM obs WHERE t < 18) k USING (territory_id, category) WHERE t < 18"))
def ffill_prefix_mean(spark, d):
    return P.filled_forward(P.dense_prefixes(P.order_panel(spark, d), [18]), "c").select(*P.SERIES, "t", tidy("z").alias("z"))


@query(f"""WITH {OBS}, {DENSE} SELECT territory_id, category, t, {t("greatest(coalesce(last_value(y IGNORE NULLS) OVER w, first_value(y IGNORE NULLS) OVER (PARTITION BY territory_id, category ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 1)")} AS z
FROM dense WINDOW w AS (PARTITION BY territory_id, category ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ffill_bfill_floor(spark, d):
    return P.filled_both(P.dense(P.order_panel(spark, d))).select(*P.SERIES, "t", tidy("z").alias("z"))


@query(f"WITH {OBS} SELECT territory_id, category, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) = 24")
def complete_series(spark, d):
    return P.complete(P.order_panel(spark, d)).groupBy(*P.SERIES).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OBS} SELECT DISTINCT category, dense_rank() OVER (ORDER BY category) - 1 AS code FROM obs")
def category_codes(spark, d):
    return P.coded(P.order_panel(spark, d)).select("category", F.col("code").cast("long").alias("code")).distinct()


@query(f"WITH {BASE} SELECT territory_id, category, c, h, target, {t('history_scale')} AS history_scale, {', '.join(f'{t(m)} AS {m}' for m in B.MODELS)} FROM wide")
def baseline_forecasts(spark, d):
    return B.baselines(P.order_panel(spark, d)).select("territory_id", "category", "c", "h", "target", *[tidy(m).alias(m) for m in ("history_scale", *B.MODELS)])


def pairs(spark, d):
    panel = P.order_panel(spark, d)
    return B.with_actual(B.baselines(panel), panel)


def _single(model: str) -> None:
    def run(spark, d):
        return pairs(spark, d).select("territory_id", "category", "c", "h", tidy(model).alias("predicted"), tidy("actual").alias("actual"))

    run.__name__ = model
    query(f"WITH {BASE} SELECT territory_id, category, c, h, {t(model)} AS predicted, {t('actual')} AS actual FROM paired")(run)


for _m in B.MODELS:
    _single(_m)


@query(f"WITH {BASE} SELECT CASE WHEN h = 12 THEN 'diagnostic' WHEN target <= 17 THEN 'validation' WHEN c >= 18 THEN 'test' ELSE 'bridge' END AS split, c, h, count(*) AS n FROM paired GROUP BY ALL")
def split_labels(spark, d):
    return pairs(spark, d).groupBy(B.split_label().alias("split"), "c", "h").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASE} SELECT model, h, {ERRORS} FROM long GROUP BY ALL")
def metrics_model_horizon(spark, d):
    return M.by_group(B.long(pairs(spark, d)), "model", "h")


@query(f"WITH {BASE} SELECT model, h, category, {ERRORS} FROM long GROUP BY ALL")
def metrics_category(spark, d):
    return M.by_group(B.long(pairs(spark, d)), "model", "h", "category")


@query(f"""WITH {BASE}, s AS (SELECT *, 'all' AS scope FROM long UNION ALL SELECT *, 'total' FROM long WHERE category = 'ALL')
SELECT model, scope, coalesce(c, -1) AS origin, count(DISTINCT s.c) AS origins, count(*) AS n, {t('avg(abs(predicted - actual))')} AS mae FROM s GROUP BY GROUPING SETS ((model, scope), (model, scope, c))""")
def metrics_grouping_sets(spark, d):
    return M.by_scope(B.long(pairs(spark, d)))


@query(f"""WITH {BASE} SELECT h, category, count(*) AS n, {t('avg(abs(seasonal_scaled - actual))')} AS mae_model, {t('avg(abs(last_value - actual))')} AS mae_base,
{t('(avg(abs(seasonal_scaled - actual)) / nullif(avg(abs(last_value - actual)), 0) - 1) * 100')} AS change_pct FROM paired GROUP BY ALL""")
def paired_change_pct(spark, d):
    return M.paired_change(pairs(spark, d), "seasonal_scaled", "last_value", "h", "category")


@query(f"""WITH {BASE}, o AS (SELECT h, territory_id, avg(abs(seasonal_naive - actual)) AS a, avg(abs(last_value - actual)) AS b FROM paired GROUP BY ALL)
SELECT h, count(*) AS territories, {t('avg(CASE WHEN a < b THEN 1 ELSE 0 END)', 6)} AS win_share FROM o GROUP BY h""")
def win_share(spark, d):
    return M.win_share(pairs(spark, d), "seasonal_naive", "last_value", "h")


@query(f"WITH {BASE} SELECT h, category, arg_min(model, (mae, model)) AS model, {t('min(mae)')} AS mae FROM (SELECT h, category, model, avg(abs(predicted - actual)) AS mae FROM long GROUP BY ALL) GROUP BY ALL")
def best_model(spark, d):
    return Q.best_model(B.long(pairs(spark, d)), "h", "category").withColumn("mae", tidy("mae"))


POLICY = f"""{BASE}, e AS (SELECT h, category, model, avg(abs(predicted - actual)) AS mae, list_position(['seasonal_scaled', 'seasonal_naive', 'damped_trend', 'last_value'], model) AS place FROM long WHERE c <= 15 GROUP BY ALL),
pick AS (SELECT h, category, arg_min(model, (mae, place)) AS best, min(mae) AS best_mae, max(mae) FILTER (WHERE model = 'seasonal_naive') AS base_mae FROM e GROUP BY ALL),
policy AS (SELECT h, category, CASE WHEN h <> 12 AND best_mae <= 0.98 * base_mae THEN best ELSE 'seasonal_naive' END AS model, best_mae, base_mae FROM pick)"""


def _policy(spark, d):
    rows = B.long(pairs(spark, d))
    return rows, Q.gated_policy(rows.where("c <= 15"), "seasonal_naive", ["seasonal_scaled", "seasonal_naive", "damped_trend", "last_value"])


@query(f"WITH {POLICY} SELECT h, category, model, {t('best_mae')} AS best_mae, {t('base_mae')} AS base_mae FROM policy")
def policy_two_percent(spark, d):
    return _policy(spark, d)[1].withColumns({c: tidy(c) for c in ("best_mae", "base_mae")})


@query(f"WITH {POLICY} SELECT territory_id, category, c, h, model, {t('predicted')} AS predicted FROM long JOIN policy USING (h, category, model) WHERE c >= 18")
def policy_applied(spark, d):
    rows, policy = _policy(spark, d)
    return Q.applied(rows.where("c >= 18"), policy).select("territory_id", "category", "c", "h", "model", tidy("predicted").alias("predicted"))


CONFORMAL = f"""{BASE}, tuned AS (SELECT h, territory_id, max(abs(predicted - actual) / history_scale) AS score FROM long WHERE model = 'seasonal_scaled' AND c <= 18 AND h < 12 GROUP BY ALL),
ranked AS (SELECT h, score, row_number() OVER (PARTITION BY h ORDER BY score) AS r, count(*) OVER (PARTITION BY h) AS n FROM tuned),
q AS (SELECT h, score AS q FROM ranked WHERE r = ceil((n + 1) * CAST(0.9 AS DOUBLE))),
bounds AS (SELECT l.*, greatest(predicted - q * history_scale, 0) AS lower, predicted + q * history_scale AS upper FROM long l JOIN q USING (h) WHERE model = 'seasonal_scaled')"""


def _bounds(spark, d):
    rows = B.long(pairs(spark, d)).where("model = 'seasonal_scaled'")
    return Q.conformal(rows.where("c <= 18 AND h < 12"), rows, groups=("h",))  # by category the smallest panels have too few territories


@query(f"WITH {CONFORMAL} SELECT h, {t('q', 6)} AS q FROM q")
def conformal_quantile(spark, d):
    rows = B.long(pairs(spark, d)).where("model = 'seasonal_scaled' AND c <= 18 AND h < 12")
    per = rows.groupBy("h", "territory_id").agg(F.max(F.abs(F.col("predicted") - F.col("actual")) / F.col("history_scale")).alias("score"))
    return Q.order_statistic(per, "score", 0.9, "h").withColumn("q", tidy("q", 6))


@query(f"WITH {CONFORMAL} SELECT territory_id, category, c, h, {t('lower')} AS lower, {t('upper')} AS upper FROM bounds")
def interval_bounds(spark, d):
    return _bounds(spark, d).select("territory_id", "category", "c", "h", tidy("lower").alias("lower"), tidy("upper").alias("upper"))


@query(f"""WITH {CONFORMAL}, s AS (SELECT h, territory_id, category, bool_and(actual BETWEEN lower AND upper) AS joint, count(*) AS n, sum(CASE WHEN actual BETWEEN lower AND upper THEN 1 ELSE 0 END) AS k, sum(upper - lower) AS width FROM bounds GROUP BY ALL)
SELECT h, CAST(sum(n) AS BIGINT) AS n, {t('sum(k) / sum(n)', 6)} AS coverage, {t('avg(CASE WHEN joint THEN 1 ELSE 0 END)', 6)} AS joint_coverage, {t('sum(width) / sum(n)')} AS mean_width FROM s GROUP BY h""")
def coverage_width(spark, d):
    return M.coverage(_bounds(spark, d), "h")


@query(f"WITH {BASE} SELECT territory_id, category, c, h, model, {t('predicted')} AS predicted FROM long")
def unpivot_models(spark, d):
    return B.long(pairs(spark, d)).select("territory_id", "category", "c", "h", "model", tidy("predicted").alias("predicted"))


@query(f"WITH {BASE} SELECT territory_id, category, c, h, {', '.join(f'{t(m)} AS {m}' for m in B.MODELS)} FROM paired")
def pivot_models(spark, d):
    rows = B.long(pairs(spark, d)).groupBy("territory_id", "category", "c", "h").pivot("model", B.MODELS).agg(F.first("predicted"))
    return rows.select("territory_id", "category", "c", "h", *[tidy(m).alias(m) for m in B.MODELS])


COHORT = f"""{OBS}, per AS (SELECT territory_id, category, count(*) AS n FROM obs WHERE t < 12 GROUP BY ALL),
pool AS (SELECT territory_id FROM per GROUP BY 1 HAVING bool_and(n >= 5) AND count(*) = 6),
ranked AS (SELECT territory_id, row_number() OVER (ORDER BY sha256('42:' || territory_id), territory_id) AS place FROM pool)"""


def _pool(spark, d):
    return C.eligible(P.order_panel(spark, d), 6, 5)


@query(f"WITH {COHORT} SELECT territory_id, place FROM ranked WHERE place <= 10")
def hash_cohort(spark, d):
    return C.hash_ranked(_pool(spark, d), "42").where("place <= 10").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {COHORT} SELECT territory_id, category, t, {t('y')} AS y FROM obs SEMI JOIN (SELECT * FROM ranked WHERE place <= 5) k USING (territory_id)")
def semi_cohort(spark, d):
    few = C.hash_ranked(_pool(spark, d), "42").where("place <= 5")
    return P.order_panel(spark, d).join(few, "territory_id", "left_semi").select("territory_id", "category", "t", tidy("y").alias("y"))


@query(f"""WITH {COHORT} SELECT territory_id, row_number() OVER (ORDER BY sha256('43:' || territory_id), territory_id) AS place FROM pool ANTI JOIN (SELECT * FROM ranked WHERE place <= 5) k USING (territory_id) QUALIFY row_number() OVER (ORDER BY sha256('43:' || territory_id), territory_id) <= 5""")
def anti_cohort(spark, d):
    few = C.hash_ranked(_pool(spark, d), "42").where("place <= 5")
    rest = _pool(spark, d).join(few, "territory_id", "left_anti")
    return C.hash_ranked(rest, "43").where("place <= 5").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {COHORT}, fives AS (SELECT territory_id FROM ranked WHERE place <= 5), others AS (SELECT territory_id FROM pool ANTI JOIN fives USING (territory_id) QUALIFY row_number() OVER (ORDER BY sha256('43:' || territory_id), territory_id) <= 5)
SELECT count(*) AS common FROM fives JOIN others USING (territory_id)""")
def disjoint_cohorts(spark, d):
    return hash_cohort(spark, d).where("place <= 5").select("territory_id").intersect(anti_cohort(spark, d).select("territory_id")).agg(F.count(F.lit(1)).alias("common"))


@query(f"""WITH {SUPPLIERS}, w AS (SELECT territory_id, avg(y) FILTER (WHERE t < 12) AS m FROM obs GROUP BY 1 HAVING count(*) >= 24), r AS (SELECT territory_id, row_number() OVER (ORDER BY m, territory_id) - 1 AS at, count(*) OVER () AS n FROM w)
SELECT territory_id, r."at" AS place FROM r WHERE list_contains(list_transform(range(0, 8), lambda i: CAST(floor((i + 0.5) * n / 8) AS BIGINT)), r."at")""".replace("AS at,", 'AS "at",'))
def pilot_cohort(spark, d):
    return C.spread_cohort(P.supplier_panel(spark, d), "ALL", 8, 24).select("territory_id", F.col("at").cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedupe_latest_version(spark, d):
    return C.latest_version(spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query(f"""WITH {BASE}, l AS (SELECT category, h, c AS origin, target, avg(abs(seasonal_scaled - actual)) AS loss FROM paired GROUP BY ALL), o AS (SELECT DISTINCT c FROM cases),
m AS (SELECT o.c, l.category, l.h, l.loss, row_number() OVER (PARTITION BY o.c, l.category, l.h ORDER BY l.target DESC, l.origin DESC) AS r FROM l JOIN o ON l.target < o.c)
SELECT c, category, h, count(*) AS n, {t('avg(loss)')} AS loss FROM m WHERE r <= 6 GROUP BY ALL""")
def theta_matured_losses(spark, d):
    losses = pairs(spark, d).groupBy("category", "h", F.col("c").alias("origin"), "target").agg(F.avg(F.abs(F.col("seasonal_scaled") - F.col("actual"))).alias("loss"))
    origins = sorted({c for c, _ in B.CASES})
    matured = losses.withColumn("c", F.explode(F.array(*map(F.lit, origins)))).where("target < c")
    last = matured.withColumn("r", F.row_number().over(Window.partitionBy("c", "category", "h").orderBy(F.desc("target"), F.desc("origin")))).where("r <= 6")
    return last.groupBy("c", "category", "h").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("loss")).alias("loss"))


@query(f"WITH {BASE}, k AS (SELECT territory_id, category, c, h, count(DISTINCT model) AS models, count(*) AS n FROM long GROUP BY ALL) SELECT count(*) AS keys, CAST(sum(CASE WHEN models <> 4 OR n <> 4 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM k")
def pairing_check(spark, d):
    per = B.long(pairs(spark, d)).groupBy("territory_id", "category", "c", "h").agg(F.countDistinct("model").alias("models"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.sum(F.when((F.col("models") != 4) | (F.col("n") != 4), 1).otherwise(0)).alias("violations"))


@query(f"WITH {BASE} SELECT h, {t('quantile_cont(seasonal_scaled - actual, 0.025)')} AS lo, {t('quantile_cont(seasonal_scaled - actual, 0.975)')} AS hi, {t('median(abs(seasonal_scaled - actual))')} AS median_error FROM paired GROUP BY h")
def interpolated_quantiles(spark, d):
    e = F.col("seasonal_scaled") - F.col("actual")
    return pairs(spark, d).groupBy("h").agg(tidy(F.percentile(e, F.lit(0.025))).alias("lo"), tidy(F.percentile(e, F.lit(0.975))).alias("hi"), tidy(F.median(F.abs(e))).alias("median_error"))


#: Draws of territories and of months.
DRAWS, MONTH_DRAWS = 2000, 10_000


@query(f"""WITH {BASE}, s AS (SELECT territory_id, sum(abs(seasonal_scaled - actual)) AS a, sum(abs(last_value - actual)) AS b, count(*) AS n FROM paired GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY territory_id) - 1 AS at0, count(*) OVER () AS size FROM s),
draws AS (SELECT draw, CAST(('0x' || substr(md5('boot:' || draw || ':' || k), 1, 8)) AS BIGINT) % size AS at0 FROM (SELECT unnest(range(0, {DRAWS})) AS draw), (SELECT size, unnest(range(0, size)) AS k FROM (SELECT DISTINCT size FROM i)))
SELECT draw, {t('(sum(a) - sum(b)) / sum(n)')} AS difference FROM draws JOIN i USING (at0) GROUP BY draw""")
def bootstrap_draws(spark, d):
    from ..operators.bootstrap import cluster_draws

    return cluster_draws(pairs(spark, d), "territory_id", F.abs(F.col("seasonal_scaled") - F.col("actual")), F.abs(F.col("last_value") - F.col("actual")), DRAWS).select("draw", tidy("difference").alias("difference"))


MONTHS = f"""{BASE}, m AS (SELECT c, avg(abs(seasonal_scaled - actual)) AS a, avg(abs(last_value - actual)) AS b FROM paired WHERE h = 1 GROUP BY c),
i AS (SELECT *, row_number() OVER (ORDER BY c) - 1 AS at0, count(*) OVER () AS size FROM m),
draws AS (SELECT draw, CAST(('0x' || substr(md5('month:' || draw || ':' || k), 1, 8)) AS BIGINT) % size AS at0 FROM (SELECT unnest(range(0, {MONTH_DRAWS})) AS draw), (SELECT size, unnest(range(0, size)) AS k FROM (SELECT DISTINCT size FROM i))),
ds AS (SELECT draw, (sum(a) - sum(b)) / count(*) AS difference FROM draws JOIN i USING (at0) GROUP BY draw)"""


@query(f"WITH {MONTHS} SELECT {t('quantile_cont(difference, 0.025)')} AS low, {t('quantile_cont(difference, 0.975)')} AS high FROM ds")
def month_bootstrap(spark, d):
    """Origins are what is drawn: a row for each origin's mean errors."""
    from ..operators.bootstrap import cluster_draws, interval

    error = lambda m: F.avg(F.abs(F.col(m) - F.col("actual")))
    by_origin = pairs(spark, d).where("h = 1").groupBy("c").agg(error("seasonal_scaled").alias("a"), error("last_value").alias("b"))
    return interval(cluster_draws(by_origin, "c", F.col("a"), F.col("b"), MONTH_DRAWS, "month")).select(tidy("low").alias("low"), tidy("high").alias("high"))


DELAYED = BASE.replace("cases(c, h) AS (VALUES ", "cases(c, h) AS (SELECT c - 1, h + 1 FROM (VALUES ").replace("(23, 1))", "(23, 1)) v(c, h))")


@query(f"WITH {DELAYED} SELECT territory_id, category, c + 1 AS c, h - 1 AS h, {t('seasonal_scaled')} AS predicted FROM wide")
def delay_sensitivity(spark, d):
    from ..operators.export import delayed

    return delayed(P.order_panel(spark, d), B.CASES).select(*P.SERIES, "c", "h", tidy("seasonal_scaled").alias("predicted"))


EXPORT = BASE.replace(BASE[BASE.index("cases(c, h)") : BASE.index("ratios AS")], "cases(c, h) AS (VALUES (24, 1), (24, 3), (24, 6), (24, 12)),\n")


@query(f"""WITH {EXPORT} SELECT territory_id, category, h, {t('seasonal_scaled')} AS predicted, CASE WHEN h = 12 THEN 'diagnostic' WHEN n < 24 THEN 'incomplete' ELSE 'ok' END AS status
FROM wide JOIN (SELECT territory_id, category, count(*) AS n FROM obs GROUP BY ALL) s USING (territory_id, category)""")
def export_forecasts(spark, d):
    from ..operators.export import export

    return export(P.order_panel(spark, d)).select(*P.SERIES, "h", tidy("predicted").alias("predicted"), "status")

"""SQL of the shared relations, for the oracles."""

PRICE = "CAST(round({0} * 100) AS BIGINT)"

OBS = """raw AS (
  SELECT c_nationkey AS territory_id, o_orderpriority AS category, (year(o_orderdate) - 1999) * 12 + month(o_orderdate) - 1 AS t, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey
), every AS (SELECT territory_id, category, t, cents FROM raw UNION ALL SELECT territory_id, 'ALL', t, cents FROM raw),
obs AS (SELECT territory_id, category, t, CAST(sum(cents) AS DOUBLE) / (100.0 * count(*)) AS y FROM every WHERE t BETWEEN 0 AND 23 GROUP BY 1, 2, 3)"""

SUPPLIERS = """obs AS (
  SELECT l_suppkey AS territory_id, 'ALL' AS category, (year(l_shipdate) - 1999) * 12 + month(l_shipdate) - 1 AS t, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (100.0 * count(*)) AS y
  FROM lineitem WHERE (year(l_shipdate) - 1999) * 12 + month(l_shipdate) - 1 BETWEEN 0 AND 23 GROUP BY 1, 2, 3)"""

DENSE = """grid AS (SELECT territory_id, category, g.t FROM (SELECT DISTINCT territory_id, category FROM obs), (SELECT unnest(range(0, 24)) AS t) g),
dense AS (SELECT g.territory_id, g.category, g.t, o.y FROM grid g LEFT JOIN obs o USING (territory_id, category, t))"""

CASES = "cases(c, h) AS (VALUES (12, 1), (12, 3), (12, 6), (12, 12), (15, 1), (15, 3), (15, 6), (18, 1), (18, 3), (18, 6), (21, 1), (21, 3), (23, 1))"

BASE = f"""{OBS}, {CASES},
ratios AS (SELECT a.*, CASE WHEN b.y > 0 THEN a.y / b.y END AS ratio FROM obs a LEFT JOIN obs b ON a.territory_id = b.territory_id AND a.category = b.category AND a.t = b.t + 12),
known AS (SELECT r.*, o.c, row_number() OVER (PARTITION BY territory_id, category, o.c ORDER BY t DESC) AS age FROM ratios r JOIN (SELECT DISTINCT c FROM cases) o ON r.t < o.c),
per AS (
  SELECT territory_id, category, c, arg_max(y, t) AS last, max(t) AS t_last, count(*) AS n, regr_slope(y, t) FILTER (WHERE age <= 6) AS slope, quantile_cont(ratio, 0.5) AS ratio, greatest(avg(abs(y)), 1) AS history_scale
  FROM known GROUP BY 1, 2, 3
), wide AS (
  SELECT p.territory_id, p.category, p.c, s.h, p.c + s.h - 1 AS target, history_scale, greatest(last, 0) AS last_value, greatest(coalesce(o.y, last), 0) AS seasonal_naive,
         greatest(last + CASE WHEN n > 1 THEN coalesce(slope, 0) ELSE 0 END * 4 * (1 - pow(0.8, p.c + s.h - 1 - t_last)), 0) AS damped_trend, greatest(coalesce(o.y, last) * coalesce(ratio, 1), 0) AS seasonal_scaled
  FROM per p JOIN cases s USING (c) LEFT JOIN obs o ON o.territory_id = p.territory_id AND o.category = p.category AND o.t = p.c + s.h - 13 AND o.t < p.c
), paired AS (SELECT w.*, a.y AS actual FROM wide w JOIN obs a ON a.territory_id = w.territory_id AND a.category = w.category AND a.t = w.target),
long AS (UNPIVOT paired ON last_value, seasonal_naive, damped_trend, seasonal_scaled INTO NAME model VALUE predicted)"""


def tidy(x: str, digits: int = 4) -> str:
    return f"round({x} + 1.2345e-6, {digits})"


ERRORS = f"""count(*) AS n, {tidy('avg(abs(predicted - actual))')} AS mae, {tidy('sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0)', 6)} AS wape,
  {tidy('CASE WHEN count(*) > 1 THEN 1 - sum(pow(predicted - actual, 2)) / nullif(var_pop(actual) * count(*), 0) END', 6)} AS r2, {tidy('avg(abs(predicted - actual) / history_scale)', 6)} AS scaled_error"""

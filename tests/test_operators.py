"""Contracts of the operators: known answers, and that nothing after the origin is read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom import sources as S
from monthloom.operators import adapters, bootstrap, chain, detectors, factors, integrity, national, news, panel, policy, ridge
from monthloom.operators import baselines as B
from monthloom.operators import cohorts as C
from monthloom.operators import export as E
from monthloom.plans import registry
from monthloom.streaming import charts


def frame(spark, *series, category="a"):
    """Series of values from month 0; None is a missing month."""
    rows = [(i, category, t, float(y)) for i, ys in enumerate(series) for t, y in enumerate(ys) if y is not None]
    return spark.createDataFrame(rows, "territory_id long, category string, t int, y double")


def one(df):
    return df.first().asDict()


# The known answers of this and the next tests.
def test_known_baselines(spark):
    ramp = frame(spark, range(1, 13))
    r = {x.h: x for x in B.baselines(ramp, [(12, 1), (12, 12)]).collect()}
    assert (r[1].last_value, r[1].seasonal_naive, r[12].seasonal_naive) == (12, 1, 12)
    flat = one(B.baselines(frame(spark, [100] * 18), [(18, 1)]))
    assert all(flat[m] == pytest.approx(100) for m in B.MODELS)
    double = one(B.baselines(frame(spark, [*range(1, 13), *(2 * x for x in range(1, 7))]), [(18, 1)]))
    assert double["seasonal_scaled"] == pytest.approx(14)
    gaps = one(B.baselines(frame(spark, [50, 40, None, 20, 10, None]), [(6, 12)]))
    assert all(math.isfinite(gaps[m]) and gaps[m] >= 0 for m in B.MODELS)


FORECASTERS = {
    "baselines": lambda p: B.baselines(p, [(14, 1), (14, 3)]),
    "panel_candidates": lambda p: factors.panel_candidates(p, [(14, 1), (14, 3)]),
    "members": lambda p: factors.members(p, [(14, 1)]),
    "panel_recent": lambda p: national.panel_recent(p, [(14, 1)]),
    "ridge": lambda p: ridge.forecasts(p, [(14, 1)]),
    "boosted": lambda p: adapters.boosted(p, 14, [1], rounds=10),
    "adapted": lambda p: adapters.forecast(p, "last", 14, 1, adapted=True),
}


@pytest.mark.parametrize("name", sorted(FORECASTERS))
def test_future_is_not_read(spark, name):
    rng = np.random.default_rng(4)
    ys = [(100 + 10 * np.sin(np.arange(24) / 2) + rng.normal(0, 5, 24)).tolist() for _ in range(60)]
    p = frame(spark, *ys).unionByName(frame(spark, *[[2 * y for y in s] for s in ys], category="b"))
    changed = p.withColumn("y", F.when(F.col("t") >= 14, F.col("y") * 7 + 3).otherwise(F.col("y")))
    rows = lambda q: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in FORECASTERS[name](q).select(*sorted(FORECASTERS[name](q).columns)).collect())
    got = rows(p)
    assert got and got == rows(changed)


def test_detectors_are_causal_and_quiet_on_constants(spark):
    rng = np.random.default_rng(5)
    ys = [(100 + rng.normal(0, 5, 24)).tolist() for _ in range(12)]
    p = frame(spark, *ys)
    cut = p.withColumn("y", F.when(F.col("t") >= 18, F.col("y") * 3).otherwise(F.col("y")))
    for make in (lambda q: detectors.cusum(detectors.innovations(q), 4.0), lambda q: detectors.robust(detectors.innovations(q), "multiscale", 3.0), lambda q: detectors.change_scores(q, 2)):
        rows = lambda q: sorted((r.territory_id, r.t, round(r.score, 9)) for r in make(q).where("t < 18").collect())  # noqa: B023, E731
        assert rows(p) == rows(cut)
    flat = frame(spark, [100] * 24)
    assert detectors.cusum(detectors.innovations(flat), 4.0).where("alarm").count() == 0


def zs(spark, values):
    return spark.createDataFrame([(0, "a", t, None if v is None else float(v)) for t, v in enumerate(values)], "territory_id long, category string, t int, z double")


def test_shift_is_found_soon_and_missing_never_alarms(spark):
    z = zs(spark, [0] * 20 + [3] * 10)
    for found in (detectors.cusum(z, 4.0), detectors.ewma(z, 2.0), detectors.window_mean(z, 2.0)):
        assert 20 <= found.where("alarm").agg(F.min("t")).first()[0] <= 22
    assert detectors.cusum(zs(spark, [None] * 10), 0.1).where("alarm OR score > 0").count() == 0
    assert detectors.robust(zs(spark, [0, 0, 12, 0, 0]), "median3", 3.0).where("alarm").count() == 0
    gap = detectors.cusum(zs(spark, [3, None, 3]), 4.0).orderBy("t").collect()
    assert [r.t for r in gap] == [0, 1, 2] and gap[2].score == pytest.approx(5 / 4) and gap[1].score == 0


def test_alarm_before_the_change_is_false(spark):
    cases = spark.createDataFrame([("x", "level", 10), ("c", "control", None)], "case_id string, kind string, change int")
    early = spark.createDataFrame([("x", 5)], "case_id string, t int")
    r = detectors.case_scores(cases, early).first()
    assert (r.tp, r.fp, r.fn, r.control_rate) == (0, 1, 1, 0)
    hit = detectors.case_scores(cases, spark.createDataFrame([("x", 11), ("x", 12)], "case_id string, t int")).first()
    assert (hit.tp, hit.fp, hit.fn, hit.delay) == (1, 1, 0, 1)


def test_order_statistic(spark):
    scores = spark.createDataFrame([("g", float(i)) for i in range(19)], "k string, s double")
    assert policy.order_statistic(scores, "s", 0.9, "k").first().q == 17
    with pytest.raises(Exception, match="too few scores"):
        policy.order_statistic(scores.where("s < 2"), "s", 0.9, "k").collect()


def test_two_percent_gate(spark):
    def pick(best):
        rows = [(1, "a", m, 0.0, e) for m, e in (("base", 10.0), ("other", best))]
        return policy.gated_policy(spark.createDataFrame(rows, "h int, category string, model string, actual double, predicted double"), "base", ["base", "other"]).first().model

    assert pick(9.9) == "base" and pick(0.0) == "other"


def test_panel_candidates_known_and_categories_apart(spark):
    s1 = [100 + t % 12 for t in range(18)]
    s2 = [2 * (y + 1) - 1 for y in s1]
    got = {r.territory_id: r.common for r in factors.panel_candidates(frame(spark, s1, s2), [(18, 3)]).collect()}
    assert got == {0: pytest.approx(108), 1: pytest.approx(217)}
    both = frame(spark, s1, s2).unionByName(frame(spark, [5 * t for t in range(18)], category="b"))
    again = {r.territory_id: r.common for r in factors.panel_candidates(both, [(18, 3)]).where("category = 'a'").collect()}
    assert again == got


def test_fill(spark):
    p = frame(spark, [None, 2, None, 4], [1, None, 3, 4])
    got = {(r.territory_id, r.t): r.z for r in panel.filled_forward(panel.dense_prefixes(p, [4]), "c").collect()}
    assert (got[0, 0], got[0, 2], got[1, 1]) == (3, 2, 1) and len(got) == 8


def test_national_growth_over_a_short_prefix(spark):
    v = [(f, m, math.exp(0.01 * m)) for f in ("total",) for m in range(-48, 24)]
    series = spark.createDataFrame(v, "field string, m int, v double")
    p = frame(spark, [50 * math.exp(0.01 * t) for t in range(3)])
    r = national.level_forecasts(p, series, [(3, 12)], 1).first()
    assert r.national_growth == pytest.approx(50 * math.exp(0.02) * math.exp(0.12)) and r.level3 == pytest.approx(50 * math.exp(0.14))
    changed = series.withColumn("v", F.when(F.col("m") >= 2, 99.0).otherwise(F.col("v")))
    assert national.level_forecasts(p, changed, [(3, 12)], 1).first().level3 == r.level3
    later = series.withColumn("v", F.when(F.col("m") >= 1, 99.0).otherwise(F.col("v")))
    known = lambda s: [(r.m, r.v) for r in national.seen(s, [3], 2).orderBy("m").collect()]
    assert known(series) == known(later)


def test_news_strict_boundary(spark):
    dates = spark.createDataFrame([("1999-08-15",), ("1999-08-17",), ("1990-01-01",)], "d string").select(F.to_date("d").alias("as_of"))
    got = {str(r.as_of): r for r in news.features(dates, news.events(spark)).collect()}
    assert (got["1999-08-15"].rate, got["1999-08-17"].rate) == (8.5 / 25, 12 / 25)
    assert tuple(got["1990-01-01"])[1:] == (0, 0, 0, 0)


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(300, 4)), rng.uniform(0.5, 2, 300)
    w /= w.mean()
    y = x @ [1, -2, 0.5, 0] + rng.normal(size=300)
    from pyspark.ml.linalg import Vectors

    train = spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], ["features", "label", "weight"])
    model = ridge.fit(train, 100.0)
    xc, yc = x - np.average(x, axis=0, weights=w), y - np.average(y, weights=w)
    beta = np.linalg.solve(xc.T @ (w[:, None] * xc) + 100 * np.eye(4), xc.T @ (w * yc))
    assert model.coefficients.toArray() == pytest.approx(beta, rel=1e-8)


def test_early_growth_of_a_line():
    t = list(range(12))
    free = factors.early_growth(t, [0.24 / 12 * x for x in t], (0.0,) * 6)
    assert free == pytest.approx(0.24, abs=1e-6)
    assert 0 < factors.early_growth(t, [0.24 / 12 * x for x in t]) < 0.24 and factors.early_growth(t, [float(x) for x in t], (0.0,) * 6) == 0.7


def test_unmatured_losses_are_ignored(spark):
    rows = [("a", 1, m, c, c, 10.0, 10.0 + e, i) for i in range(3) for c in (12, 13, 14, 15) for m, e in (("good", 1.0), ("bad", 9.0))]
    long = spark.createDataFrame(rows, "category string, h int, model string, c int, target int, actual double, predicted double, territory_id int")
    w = {(r.c, r.model): r.weight for r in factors.mixture(long).collect()}
    assert w[12, "good"] == 0.5 and w[14, "bad"] == 0.5 and w[15, "good"] == pytest.approx(81 / 82)
    later = long.withColumn("predicted", F.when(F.col("target") >= 15, F.col("actual")).otherwise(F.col("predicted")))
    assert {(r.c, r.model): r.weight for r in factors.mixture(later).collect()} == w


def test_cohort_does_not_see_later_months(spark):
    p = frame(spark, *[[1.0] * 24] * 5, [1.0] * 8 + [None] * 16)
    early = p.where("t < 12")
    ids = lambda q: [r.territory_id for r in C.hash_cohort(q, "s", 3, 1).orderBy("place").collect()]
    assert ids(p) == ids(early) and 5 not in ids(p) and len(ids(p)) == 3


def test_observations_are_checked(spark):
    ok = spark.createDataFrame([("2023-02", 1, "a", 1.5), ("2023-01", 1, "a", 2.5)], "date string, territory_id int, category string, consumption double")
    assert sorted((r.t, r.y) for r in panel.validated(ok).collect()) == [(0, 2.5), (1, 1.5)]
    for bad in ([("2023-01", 1, "a", 2.5)] * 2, [("2023-13", 1, "a", 1.0)], [("2023-01", None, "a", 1.0)], [("2023-01", 1, "a", -1.0)], [("2023-01", 1, "a", float("nan"))]):
        with pytest.raises(ValueError, match="expectations"):
            panel.validated(spark.createDataFrame(bad, "date string, territory_id int, category string, value double"))
    with pytest.raises(ValueError, match="need"):
        panel.validated(spark.range(1))


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("2023-01", i, "кат", i / 3) for i in range(50)], S.OBSERVATIONS)
    S.write_parquet(rows, f"{tmp_path}/p", rows_a_file=18)
    assert S.content_hash(S.parquet(spark, f"{tmp_path}/p")) == S.content_hash(rows)
    with pytest.raises(Exception, match="(?i)exists"):
        S.write_parquet(rows, f"{tmp_path}/p")
    S.write_csv(rows, f"{tmp_path}/c")
    assert S.content_hash(S.csv(spark, f"{tmp_path}/c", S.OBSERVATIONS)) == S.content_hash(rows)
    S.write_json_lines(rows, f"{tmp_path}/j")
    assert S.json_rows(spark, f"{tmp_path}/j", S.OBSERVATIONS, lines=True).count() == 50
    (tmp_path / "e.json").write_text('[{"territory_id": 1, "name": "x"}, {"territory_id": 2}]')
    assert S.json_rows(spark, f"{tmp_path}/e.json", S.LOCAL_EVENTS).count() == 2
    (tmp_path / "n.csv").write_text("date,food,nonfood,catering,services\n2023-01,1,2,3,4\n")
    assert {r.field: r.v for r in S.national(spark, f"{tmp_path}/n.csv").collect()}["total"] == 10
    with pytest.raises(ValueError):
        S.small_json({"a": float("nan")})
    made = []
    make = lambda c: made.append(c) or rows.withColumn("c", F.lit(c))
    for _ in range(2):
        assert S.cached_by_origin(spark, f"{tmp_path}/o", 12, "sig", make).count() == 50
    assert made == [12]
    with pytest.raises(ValueError, match="other inputs"):
        S.cached_by_origin(spark, f"{tmp_path}/o", 12, "new", make)


def test_integrity_and_case_study(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (2, 5)], "territory_id int, v int")
    assert integrity.duplicate_keys(a, "territory_id") == 1 and integrity.overlapping(a, a) == 2 and integrity.different_sets(a, a.limit(0)) == 3
    with pytest.raises(ValueError, match="repeat"):
        integrity.validated_join(a, a, ["territory_id"])
    p = frame(spark, [100.0] * 18 + [200.0] * 6, [70.0] * 24, [30.0] * 24)
    events = spark.createDataFrame([(0, 17, 19)], "territory_id long, event_t int, available_t int")
    alarms = spark.createDataFrame([(0, 18), (0, 20), (0, 13)], "territory_id long, t int")
    r = integrity.case_study(p, alarms, events, [15, 16, 17], [18, 19, 20]).first()
    assert r.alarm_months == [18, 20] and r.news_known and r.relative_gap == pytest.approx(100 * math.log(201 / 101))
    assert integrity.differing_actuals(B.with_actual(B.baselines(p, [(18, 1)]), p), p) == 0
    assert integrity.not_finite(a.selectExpr("cast(v as double) AS v"), "v") == 0


def test_case_history(spark):
    p = frame(spark, [100.0] * 18 + [200.0] * 6, [70.0] * 24, [30.0] * 24)
    events = spark.createDataFrame([(0, 17, 19)], "territory_id long, event_t int, available_t int")
    rows = {r.t: r for r in integrity.case_history(p, {"chart": spark.createDataFrame([(0, 18)], "territory_id long, t int")}, events).collect()}
    assert len(rows) == 24 and [t for t, r in rows.items() if r.chart] == [18]
    assert not rows[18].news_known and rows[19].news_known and rows[11].relative is None and rows[17].relative == 0


def test_members_with_a_year_or_less(spark):
    rng = np.random.default_rng(8)
    ys = np.exp(4 + 0.02 * np.arange(24) + rng.normal(0, 0.1, (5, 24)))
    got = {(r.territory_id, r.c): r for r in factors.members(frame(spark, *ys.tolist()), [(12, 12), (6, 1), (3, 12), (18, 1)]).collect()}
    assert {c for _, c in got} == {3, 12, 18}  # no month a year before the target of (6, 1)
    for c, h in ((12, 12), (18, 1)):
        z = np.log1p(ys[:, :c])
        f = np.median(z, axis=0)
        s, d = c + h - 13, z - f
        pooled = factors.early_growth(list(range(c)), f.tolist()) if c <= 12 else float(np.clip(np.median((f[12:] - f[:-12])[-3:]), -0.2, 0.7))
        own = np.full(5, pooled) if c <= 12 else np.median((z[:, 12:] - z[:, :-12])[:, -3:], axis=1)
        state = 0.7 * d[:, -1] + 0.3 * np.median(d[:, -3:], axis=1)
        for i in range(5):
            r = got[i, c]
            assert r.shrink_growth == pytest.approx(math.expm1(z[i, s] + 0.75 * pooled + 0.25 * own[i]))
            assert r.pooled_growth == pytest.approx(math.expm1(z[i, s] + pooled)) and r.factor_state == pytest.approx(math.expm1(f[s] + pooled + state[i]))


def test_zero_score_has_no_direction(spark):
    z = zs(spark, [0.0, 0.0, 0.0, 2.0])
    for chart in (detectors.ewma(z, 2.0), detectors.window_mean(z, 2.0), detectors.robust(z, "median3", 2.0), detectors.robust(z, "multiscale", 2.0)):
        assert [r.direction for r in chart.orderBy("t").collect()][:3] == [0, 0, 0]


def test_confirmed_shift_against_numpy(spark):
    rng = np.random.default_rng(9)
    ys = np.exp(5 + np.cumsum(rng.normal(0, 0.05, (7, 24)), axis=1))
    x = np.log1p(ys)
    r = x - np.median(x, axis=0)
    for w in (2, 3):
        got = {(q.territory_id, q.t): q.score for q in detectors.change_scores(frame(spark, *ys.tolist()), w).collect()}
        for i in range(7):
            for t in range(12, 24):
                past = np.diff(r[i, :t])
                shift = r[i, t - w + 1 : t + 1] - np.median(r[i, t - w - 5 : t - w + 1])
                want = abs(shift).min() / max(1.4826 * np.median(abs(past - np.median(past))), 0.015) if (shift > 0).all() or (shift < 0).all() else 0.0
                assert got[i, t] == pytest.approx(want)


def test_panel_scores_against_numpy(spark):
    rng = np.random.default_rng(10)
    ys = np.exp(5 + rng.normal(0, 0.004, (9, 24)))
    g = np.log1p(ys[:, 12:]) - np.log1p(ys[:, :-12])
    factor = np.median(g, axis=0)
    want = (g - factor) / np.maximum(1.4826 * np.median(abs(g - factor), axis=0), 0.02)
    got = {(r.territory_id, r.t): r.z for r in detectors.panel_scores(frame(spark, *ys.tolist())).collect()}
    assert len(got) == 9 * 12 and all(v == pytest.approx(want[i, t - 12]) for (i, t), v in got.items())


def test_rules_of_choice(spark):
    rows = [("a", 3.0, 24, 0.6, 0.2), ("a", 3.0, 60, 0.8, 0.0), ("a", 5.0, 24, 0.5, 0.1), ("a", 5.0, 60, 0.5, 0.0), ("b", 8.0, 24, 0.5, 0.0), ("b", 8.0, 60, 0.5, 0.0)]
    s = spark.createDataFrame(rows, "method string, threshold double, length int, f1 double, control_rate double")
    best = detectors.chosen_across(s).first()
    assert (best.method, best.threshold, best.f1) == ("a", 5.0, 0.5)
    assert detectors.chosen_across(s.where("threshold = 3.0")).first().control_rate == 0.2
    assert {r.method: r.threshold for r in detectors.chosen_by_f1(s.where("length = 24"), "method").collect()} == {"a": 3.0, "b": 8.0}


def test_intervals_by_horizon_and_category(spark):
    rows = [(i, c, 1, 100.0, 100.0 + i * k, 1.0) for i in range(19) for c, k in (("a", 1), ("b", 3))]
    p = spark.createDataFrame(rows, "territory_id int, category string, h int, predicted double, actual double, history_scale double")
    assert {(r.category, r.q) for r in policy.conformal(p, p).collect()} == {("a", 17.0), ("b", 51.0)}


def test_year_ahead_keeps_the_base(spark):
    rows = [(h, "a", m, 0.0, e) for h in (1, 12) for m, e in (("base", 10.0), ("other", 0.0))]
    pairs = spark.createDataFrame(rows, "h int, category string, model string, actual double, predicted double")
    assert {r.h: r.model for r in policy.gated_policy(pairs, "base", ["base", "other"]).collect()} == {1: "other", 12: "base"}


def test_ridge_on_known_news_and_release_rule(spark, sf):
    rng = np.random.default_rng(11)
    p = frame(spark, *(100 + rng.normal(0, 5, (6, 20))).tolist())
    got = ridge.with_news(ridge.feature_rows(p, [(7, 1), (10, 1)], 1), news.events(spark), 1)
    first = {r.c: r for r in got.where("territory_id = 0").collect()}
    assert first[7].rate == pytest.approx(8.5 / 25) and first[10].rate == pytest.approx(15 / 25)  # before 1999-08-01 and 1999-11-01
    assert set(ridge.names(1, True)) <= set(got.columns)
    rows = registry.queries()["release_rule"](spark, sf).join(registry.queries()["baseline_forecasts"](spark, sf).select("territory_id", "category", "c", "h", "damped_trend", "seasonal_scaled"), ["territory_id", "category", "c", "h"]).collect()
    early = [r for r in rows if r.h == 12 or r.c < 18]
    assert early and all(r.predicted == pytest.approx(r.damped_trend if r.h == 12 else r.seasonal_scaled, abs=0.02) for r in early)


def test_adapters_and_export(spark):
    p = frame(spark, [100 * (1 + 0.1 * math.sin(t)) for t in range(24)], [50.0] * 24)
    got = {r.territory_id: r.predicted for r in adapters.forecast(p, "last", 18, 1, adapted=True).collect()}
    assert got[1] == pytest.approx(50) and 25 < got[0] < 400
    with pytest.raises(KeyError):
        adapters.forecast(p, "none", 18, 1)
    if not adapters.available("prophet"):
        with pytest.raises(RuntimeError):
            adapters.seasonal_library(p, 18, 1)
    q = spark.createDataFrame([(1, 0.5)], "h int, q double")
    rows = E.export(p, q=q).collect()
    assert len(rows) == 8 and all(r.lower <= r.predicted <= r.upper for r in rows if r.h == 1)
    assert E.markdown(q).splitlines()[2] == "| 1 | 0.5 |"


def test_bootstrap_interval_holds_the_difference(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(abs(rng.normal(1, 0.3))), float(abs(rng.normal(2, 0.3)))) for i in range(100)]
    drawn = bootstrap.cluster_draws(spark.createDataFrame(rows, "k int, a double, b double"), "k", F.col("a"), F.col("b"), 200)
    r = bootstrap.interval(drawn).first()
    assert r.low < -1 + 0.1 and r.high > -1 - 0.1 and r.high - r.low < 0.5


def test_stream_equals_batch(spark, sf):
    rows = charts.event_counts(spark, sf)
    got = sorted((r.key, r.t, round(r.score, 9), r.alarm) for r in charts.replayed(spark, rows, parts=3).collect())
    batch = detectors.cusum(rows.select(F.xxhash64("key").alias("territory_id"), F.col("key").alias("category"), F.col("t").cast("int").alias("t"), "z"), 4.0)
    assert got == sorted((r.category, r.t, round(r.score, 9), r.alarm) for r in batch.collect())


def test_settings_are_checked():
    import json

    good = {"growth_window": 3, "level_window": 3, "growth_clip": [-0.1, 0.5], "local_growth_clip": [-0.2, 0.7], "pooled_growth_weight": 0.75}
    assert national.Settings.of(json.dumps(good)).level_window == 3
    for change in ({"level_window": 0}, {"growth_window": True}, {"growth_window": 2.5}, {"growth_clip": [2, 1]}, {"local_growth_clip": [0, float("inf")]}, {"pooled_growth_weight": 2}, {"more": 1}):
        with pytest.raises(ValueError):
            national.Settings.of(json.dumps(good | change))
    with pytest.raises(ValueError):
        national.Settings.of(json.dumps({k: v for k, v in good.items() if k != "level_window"}))


def test_settings_change_the_levels(spark):
    p = frame(spark, [100.0 + 5 * (i % 7) + i for i in range(24)], [60.0 + 3 * (i % 5) for i in range(24)])
    series = spark.createDataFrame([("total", m, 200.0 + m + 3 * (m % 4)) for m in range(-48, 24)], "field string, m int, v double")
    at = lambda **k: {(r.territory_id, r.h): r for r in national.level_forecasts(p, series, [(18, 1), (18, 12)], settings=national.Settings(**k)).collect()}
    base = at()
    assert {k: tuple(r) for k, r in base.items()} == {k: tuple(r) for k, r in at(level_window=3, growth_window=3).items()}
    narrow = at(level_window=1)
    assert all(r.level3 == pytest.approx(r.level1) for r in narrow.values()) and any(narrow[k].level3 != base[k].level3 for k in base)
    assert any(at(pooled_growth_weight=0.0)[k].seasonal != base[k].seasonal for k in base)


def test_trend_weights_are_the_penalised_fit():
    t = np.arange(9.0)
    f = np.random.default_rng(3).normal(size=9)
    x = np.stack([np.ones(9), (t - t.mean()) / 12, np.sin(np.pi * t / 6), np.cos(np.pi * t / 6), np.sin(np.pi * t / 3), np.cos(np.pi * t / 3)], axis=1)
    beta = np.linalg.solve(x.T @ x + np.diag(factors.PENALTIES), x.T @ f)
    assert np.dot(factors.trend_weights(t.tolist()), f) == pytest.approx(beta[1], abs=1e-6)


def test_adapted_last_equals_the_wrapper(spark):
    rng = np.random.default_rng(4)
    p = frame(spark, *np.exp(5 + 0.3 * np.sin(np.arange(24) / 2) + rng.normal(0, 0.1, (4, 24))).tolist())
    own = {(r.territory_id, r.category): r.adapted for r in chain.adapted_last(p, [(18, 3), (12, 1)]).where("c = 18").collect()}
    wrapped = {(r.territory_id, r.category): r.predicted for r in adapters.forecast(p, "last", 18, 3, adapted=True).collect()}
    assert own == pytest.approx(wrapped)


def test_policy_keeps_the_base_without_enough_gain(spark):
    rows = spark.createDataFrame([(1, "a", 12, 100.0, 110.0, 109.9), (1, "b", 12, 100.0, 110.0, 105.0), (12, "b", 12, 100.0, 110.0, 100.0), (1, "a", 18, 100.0, 500.0, 100.0)], "h int, category string, c int, actual double, v2 double, other double")
    policy = chain.policy_of(rows, ["v2", "other"], 15)
    assert {(r.h, r.category): r.model for r in policy.collect()} == {(1, "a"): "v2", (1, "b"): "other", (12, "b"): "v2"}
    got = chain.chosen_value(rows.withColumn("fixed", F.lit(7.0)), policy, ["v2", "other"], "value", "fixed")
    assert sorted((r.h, r.category, r.c, r.value) for r in got.collect()) == [(1, "a", 12, 110.0), (1, "a", 18, 500.0), (1, "b", 12, 105.0), (12, "b", 12, 7.0)]


def test_violations_are_counted(spark):
    p = frame(spark, [100.0 + i for i in range(24)], [50.0] * 24)
    rows = B.with_actual(B.baselines(p, [(18, 1), (18, 3)]), p)
    long = B.long(rows)
    used, choice = spark.createDataFrame([(1, "ALL", "last_value")], "h int, category string, model string"), spark.createDataFrame([(1, "ALL", "seasonal_naive")], "h int, category string, model string")
    fine = integrity.replayed(rows, p, long, long, used, used).first()
    assert tuple(fine)[:5] == (0, 0, 0, 0, 0) and fine.pairs == rows.count()
    broken = rows.withColumn("actual", F.when(F.col("h") == 1, F.col("actual") + 1).otherwise(F.col("actual"))).unionByName(rows.where("h = 3"))
    bad = integrity.replayed(broken, p, long, B.long(broken), used, choice).first()
    assert bad.duplicates > 0 and bad.wrong_actuals > 0 and bad.wrong_errors > 0 and bad.wrong_choices == 1
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert tuple(integrity.set_differences(a, b).first()) == (1, 2)
    with pytest.raises(ValueError):
        integrity.validated_join(a, a, ["k"])


@pytest.mark.parametrize("method, batch", [("ewma", lambda z: detectors.ewma(z, 2.0)), ("window_mean", lambda z: detectors.window_mean(z, 2.0)), ("median3", lambda z: detectors.robust(z, "median3", 2.0)), ("cusum", lambda z: detectors.cusum(z, 2.0))])
def test_streams_keep_missing_values(spark, method, batch):
    z = [None, 0.5, 3.0, None, 2.5, 2.5, -1.0, None, -4.0, -3.0, 0.0, 1.0]
    rows = spark.createDataFrame([("k", t, v) for t, v in enumerate(z)], "key string, t long, z double")
    got = sorted((r.t, round(r.score, 9), r.alarm, r.direction) for r in charts.replayed(spark, rows, parts=3, method=method, threshold=2.0).collect())
    want = batch(rows.select(F.lit(1).alias("territory_id"), F.col("key").alias("category"), F.col("t").cast("int").alias("t"), "z"))
    assert got == sorted((r.t, round(r.score, 9), r.alarm, r.direction) for r in want.collect()) and len(got) == len(z)


def test_stream_scores_look_back_only(spark, tmp_path):
    import datetime

    start = datetime.datetime(2000, 1, 1)
    at = lambda n: [(start + datetime.timedelta(hours=h), "a") for h in range(30) for _ in range(n(h))]
    for name, n in (("one", lambda h: 1 + h % 3), ("two", lambda h: 1 + h % 3 + 20 * (h >= 20))):
        spark.createDataFrame(at(n), "ts timestamp, event_type string").write.parquet(f"{tmp_path}/{name}/events.parquet")
    one, two = ({r.t: r.z for r in charts.event_counts(spark, f"{tmp_path}/{name}").collect()} for name in ("one", "two"))
    first = min(one)
    assert all(one[first + k] is None for k in range(12)) and all(one[first + k] == two[first + k] for k in range(20)) and one[first + 20] != two[first + 20]

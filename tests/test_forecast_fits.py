"""Sparse changepoints, chosen differencing and supplied regressors."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import forecast_fits as ff
from halyard.operators import forecast_models as fm


def design(n, changes=25):
    t = np.arange(n) / (n - 1)
    at = 0.8 * np.arange(1, changes + 1) / (changes + 1)
    x = np.column_stack([np.ones(n), t, *[np.maximum(0, t - s) for s in at]])
    return x, np.array([False, False, *[True] * changes]), at


def test_a_planted_slope_change_is_found_and_others_are_zero():
    x, sparse, at = design(600)
    rng = np.random.default_rng(0)
    y = 0.2 + 0.1 * x[:, 1] + 0.9 * np.maximum(0, x[:, 1] - at[11]) + 0.01 * rng.normal(size=600)
    coef, noise = ff.laplace_map(x, y, sparse, np.array([np.inf, 5.0, *[0.05] * 25]))
    delta = coef[sparse]
    near = np.abs(np.arange(25) - 11) <= 1
    assert np.abs(delta[near]).sum() > 0.9 * np.abs(delta).sum() and delta[near].sum() == pytest.approx(0.9, abs=0.08)
    assert (delta == 0).sum() >= 17 and noise == pytest.approx(0.01, rel=0.15)


def test_no_change_means_no_change():
    x, sparse, _ = design(400)
    y = 0.5 + 0.3 * x[:, 1] + 0.05 * np.random.default_rng(1).normal(size=400)
    coef, _ = ff.laplace_map(x, y, sparse, np.array([np.inf, 5.0, *[0.05] * 25]))
    assert np.abs(coef[sparse]).max() < 0.05 and coef[1] == pytest.approx(0.3, abs=0.05)


def test_the_fit_is_the_minimum_of_its_objective():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(80), rng.normal(size=(80, 6))])
    y = x @ np.array([1, 0.5, 0, 0, 0.3, 0, -0.2]) + 0.1 * rng.normal(size=80)
    sparse, scales = np.array([0, 0, 0, 1, 1, 1, 1], bool), np.array([np.inf, 1, 1, 0.1, 0.1, 0.1, 0.1])
    b, noise = ff.laplace_map(x, y, sparse, scales)
    v = noise**2

    def objective(b):
        return ((y - x @ b) ** 2).sum() / (2 * v) + (b[~sparse] ** 2 / (2 * scales[~sparse] ** 2)).sum() + (np.abs(b[sparse]) / scales[sparse]).sum()

    assert all(objective(b + 1e-3 * rng.normal(size=7)) >= objective(b) - 1e-6 for _ in range(300))


def test_wider_changepoint_scale_allows_more_changes():
    x, sparse, _ = design(500)
    t = x[:, 1]
    y = 0.3 * np.sin(5 * t) + 0.02 * np.random.default_rng(3).normal(size=500)
    sizes = [np.abs(ff.laplace_map(x, y, sparse, np.array([np.inf, 5.0, *[s] * 25]))[0][sparse]).sum() for s in (0.001, 0.05, 5.0)]
    assert sizes[0] < sizes[1] <= sizes[2]


def test_trend_spread_grows_ahead_and_is_zero_inside():
    s = ff.trend_spread(np.array([0.5, 0.0, -0.1]), np.array([-0.2, 0.0, 0.1, 0.2]))
    assert s[0] == s[1] == 0 < s[2] < s[3] and not ff.trend_spread(np.zeros(3), np.array([0.3])).any()


def walks(n=420, seed=0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    weekly = e.copy()
    for i in range(7, n):
        weekly[i] += weekly[i - 7]
    return e, np.cumsum(e), weekly


def test_differencing_by_tests():
    found = [[ff.differencing(y) for y in walks(seed=s)] for s in range(20)]
    share = lambda k, wanted: np.mean([f[k] == wanted for f in found])
    assert share(0, (0, 0)) >= 0.85 and share(1, (1, 0)) >= 0.85
    assert np.mean([f[2][1] == 1 for f in found]) >= 0.9
    # twice summed noise needs two differences, a constant none
    assert ff.differencing(np.cumsum(walks()[1]))[0] == 2 and ff.differencing(np.full(100, 3.0)) == (0, 0)


def test_psi_weights_of_known_models():
    noise, walk, weekly = walks(800, 4)
    _, se, order = ff.arima(walk, 16)
    assert order.startswith("(") and ",1," in order and se[15] > 2.5 * se[0]
    f, se, order = ff.arima(noise, 16)
    assert order.split(")")[0].split(",")[1] == "0" and se[15] < 1.5 * se[0]
    f, se, order = ff.arima(weekly, 21)
    assert ",1," in order.split(")")[1] and se[20] > se[0]


def test_forecast_of_a_weekly_pattern_with_trend():
    n = np.arange(300)
    y = 100 + 0.5 * n + 10 * np.sin(2 * np.pi * n / 7) + np.random.default_rng(1).normal(size=300)
    f, _, _ = ff.arima(y, 28)
    m = np.arange(300, 328)
    assert np.abs(f - (100 + 0.5 * m + 10 * np.sin(2 * np.pi * m / 7))).mean() < 3


def test_stepwise_tries_few_orders_and_stops_at_a_minimum():
    z = walks(400, 6)[0]
    best, tried = ff.stepwise(z, True)
    assert tried < 4 * 4 * 3 * 3
    p, q, sp, sq = best["order"]
    for o in [(p + 1, q, sp, sq), (p, q + 1, sp, sq), (p - 1, q, sp, sq), (p, q, sp, sq - 1)]:
        if all(0 <= v <= m for v, m in zip(o, (3, 3, 2, 2))):
            assert ff._fit_arma(z, o, True)["aic"] >= best["aic"] - 1e-9


@pytest.fixture(scope="module")
def demand(spark):
    rng = np.random.default_rng(8)
    rows = []
    for name in ("a", "b"):
        for i in range(240):
            spend = float(rng.uniform(0, 10))
            rows.append((name, dt.date(2024, 1, 1) + dt.timedelta(days=i), 100 + 4 * spend + float(rng.normal()), spend, 0.0, 1.0, 0.0, 0.0, 0.0))
    kind = "ds date, y double, marketing_spend double, discount_pct double, avg_order_value double, is_promo double, is_holiday double, is_weekend double"
    return spark.createDataFrame(rows, f"{fm.KEY} string, {kind}")


def test_supplied_future_regressors_move_the_forecast(spark, demand):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=240 + i) for i in range(10)]
    low = spark.createDataFrame([(d, 0.0) for d in days], "ds date, marketing_spend double")
    high = spark.createDataFrame([("a", d, 10.0) for d in days], f"{fm.KEY} string, ds date, marketing_spend double")
    mean = lambda f: {r[fm.KEY]: r["m"] for r in fm.additive_forecast(demand, 10, future=f).groupBy(fm.KEY).agg(F.avg("yhat").alias("m")).collect()}
    none, below, above = mean(None), mean(low), mean(high)
    assert all(below[k] == pytest.approx(100, abs=3) and none[k] == pytest.approx(120, abs=5) for k in "ab")
    assert above["a"] == pytest.approx(140, abs=3) and above["b"] == pytest.approx(none["b"], abs=0.5)


def test_prior_scales_are_arguments(demand):
    flat = fm.additive_forecast(demand, 5, regressor_scale=1e-6, seasonality_scale=1e-6, holiday_scale=1e-6)
    assert flat.groupBy(fm.KEY).agg(F.stddev("yhat").alias("s")).filter("s > 0.5").count() == 0


def test_components_add_up(demand):
    parts = fm.additive_forecast(demand, 5, components=True)
    names = [c for c in parts.columns if c not in (fm.KEY, "ds", "yhat")]
    assert parts.filter(F.abs(sum(F.col(c) for c in names) - F.col("yhat")) > 1e-6).count() == 0

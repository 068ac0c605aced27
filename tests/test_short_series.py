"""One short series neither loses its forecast nor disables a model for others."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import forecast_models as fm

LENGTHS = (1, 2, 12, 25, 40, 200)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n in LENGTHS:
        for i in range(n):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=i)
            y = 50 + 10 * np.sin(2 * np.pi * i / 7) + float(rng.normal())
            rows.append((f"s{n}", day, float(y), 0.0, 0.0, 1.0))
    return spark.createDataFrame(rows, f"{fm.KEY} string, ds date, y double, marketing_spend double, discount_pct double, avg_order_value double")


@pytest.mark.parametrize("model", ["ARIMA", "N-BEATS"])
def test_every_series_gets_its_horizon(mixed, model):
    got = {r[fm.KEY]: r for r in fm.MODELS[model](mixed, 10).groupBy(fm.KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("yhat").isNull() | F.isnan("yhat")).alias("bad")).collect()}
    assert set(got) == {f"s{n}" for n in LENGTHS}
    assert all(r["n"] == 10 and r["bad"] == 0 for r in got.values())


def test_arima_still_fits_the_long_series(mixed):
    orders = {r[fm.KEY]: r["order"] for r in fm.arima_forecast(mixed, 5).select(fm.KEY, "order").distinct().collect()}
    assert orders["s200"] != fm.FALLBACK_ORDER and orders["s1"] == fm.FALLBACK_ORDER


@pytest.fixture(scope="module")
def full(mixed):
    return mixed.withColumns({"is_promo": F.lit(0.0), "is_holiday": F.lit(0.0), "is_weekend": F.lit(0.0)})


def horizons(df):
    return {(r[fm.KEY], r["model"]): (r["n"], r["bad"]) for r in df.groupBy(fm.KEY, "model").agg(
        F.countDistinct("ds").alias("n"), F.count_if(F.col("yhat").isNull() | F.isnan("yhat")).alias("bad")).collect()}


def test_best_model_of_every_length(full):
    got = horizons(fm.forecast_best(full))
    assert {k for k, _ in got} == {f"s{n}" for n in LENGTHS} and len(got) == len(LENGTHS)
    assert set(got.values()) == {(30, 0)}


def test_modes(full):
    every = horizons(fm.forecast(full, 8, "all"))
    assert set(every) == {(f"s{n}", m) for n in LENGTHS for m in fm.MODELS} and set(every.values()) == {(8, 0)}
    named = horizons(fm.forecast(full, 8, "ARIMA"))
    assert set(named) == {(f"s{n}", "ARIMA") for n in LENGTHS} and set(named.values()) == {(8, 0)}
    with pytest.raises(ValueError):
        fm.forecast(full, 8, "other")


def test_metrics_documents(full):
    leaderboard = fm.holdout_evaluation(full, 30).checkpoint()
    docs = {r[fm.KEY]: r for r in fm.metrics_documents(leaderboard).collect()}
    assert set(docs) == {f"s{n}" for n in LENGTHS if n > 1}  # one day leaves nothing to compare
    for n in LENGTHS[1:]:
        own = docs[f"s{n}"]
        assert own["best_model"] in own["models"] and all(m["n_test"] == min(30, n - 1) for m in own["models"].values())
        assert own["models"][own["best_model"]]["mape"] == min(m["mape"] for m in own["models"].values())

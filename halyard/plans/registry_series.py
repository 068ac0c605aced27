"""Registered demand-series queries (DD view)."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.functions.numeric import rnd
from halyard.functions import calendar as cal
from halyard.operators import forecast_eval as fe
from halyard.operators import timeseries as ts
from halyard.plans.materialize import daily_demand_fact

HORIZON = 30
HOLDOUT = 30
WINDOW_L, WINDOW_H = 14, 7
STAND_INS = ("tail_mean_7", "tail_mean_30")


def _dd(spark, d):
    """The daily-demand fact (one row per series and day), built from the
    order tables once per session and stored like the source's demand table."""
    return daily_demand_fact(spark, d)


def _reg(spark, d):
    return ts.regularize_daily(_dd(spark, d))


def b23_calendar_features(spark, d):
    return _dd(spark, d).select("series_id", "ds", "day_of_week", "month", "week_of_year", "is_weekend")


def b24_event_flags(spark, d):
    return _dd(spark, d).select("series_id", "ds", "is_holiday", "is_promo")


def b25_net_revenue(spark, d):
    return _dd(spark, d).select(
        "series_id", "ds", rnd(cal.net_revenue("y", "avg_order_value", "discount_pct"), 4).alias("net_revenue"))


def _future(spark, d):
    return ts.future_dates(_reg(spark, d), HORIZON)


def _stand_in_forecasts(spark, d):
    reg = _reg(spark, d)
    fut = ts.future_dates(reg, HORIZON)
    return fe.tail_mean_forecasts(reg, fut, (7, 30))


def _holdout_forecasts(spark, d):
    reg = ts.time_holdout(_reg(spark, d), HOLDOUT)
    train = reg.filter(F.col("split") == "train")
    test = reg.filter(F.col("split") == "test")
    fc = fe.tail_mean_forecasts(train, test, (7, 30))
    return fc, test


def b26_postprocess_forecast(spark, d):
    fc, _ = _holdout_forecasts(spark, d)
    return fc


def c01_regressor_join(spark, d):
    dd = _dd(spark, d)
    # supplied regressors: last year's same weekday (ds + 364 days)
    supplied = dd.select("series_id", F.date_add("ds", 364).alias("ds"), "is_promo", "is_holiday",
                         "is_weekend", "marketing_spend", "discount_pct")
    out = ts.with_regressors(_future(spark, d), supplied, dd,
                             ["is_promo", "is_holiday", "is_weekend"], ["marketing_spend", "discount_pct"])
    return out.withColumns({c: rnd(c, 6) for c in ("marketing_spend", "discount_pct")})


def c03_holiday_window_join(spark, d):
    dd = _dd(spark, d)
    y0 = dd.agg(F.min(F.year("ds"))).scalar()
    y1 = dd.agg(F.max(F.year("ds"))).scalar()
    calendar = ts.holiday_calendar(spark, y0, y1)
    return ts.holiday_window_join(dd.select("series_id", "ds", "y"), calendar).select(
        "series_id", "ds", "y", "holiday", "holiday_ds", "offset")


def c05_model_alignment(spark, d):
    return fe.align_models(_stand_in_forecasts(spark, d), list(STAND_INS))


def d27_forecast_summary(spark, d):
    return fe.forecast_summary(_stand_in_forecasts(spark, d))


def d28_model_comparison_summary(spark, d):
    return fe.model_comparison_summary(_stand_in_forecasts(spark, d))


def d29_forecast_metrics(spark, d):
    fc, test = _holdout_forecasts(spark, d)
    return fe.forecast_metrics(fc, test)


def d30_pick_best_model(spark, d):
    fc, test = _holdout_forecasts(spark, d)
    return fe.pick_best_model(fe.forecast_metrics(fc, test), priority=STAND_INS)


DESCRIBE_COLS = ["y", "revenue", "avg_order_value", "marketing_spend", "discount_pct"]


def d35_describe(spark, d):
    out = ts.describe(_dd(spark, d), DESCRIBE_COLS)
    return out.select("column", "count", *[rnd(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def e02_event_carryover(spark, d):
    return ts.event_carryover(_dd(spark, d))


def e03_tail_stats(spark, d):
    st = ts.tail_stats(_reg(spark, d), 30, 60)
    return st.select("series_id", rnd("tail_mean", 6).alias("tail_mean"),
                     rnd("tail_sigma", 6).alias("tail_sigma"), "n_tail")


def e04_supervised_windows(spark, d):
    return ts.supervised_windows(_reg(spark, d), WINDOW_L, WINDOW_H)


def e05_regularize_daily(spark, d):
    return _reg(spark, d)


def e06_time_holdout(spark, d):
    return ts.time_holdout(_reg(spark, d), HOLDOUT)


def e08_future_dates(spark, d):
    return _future(spark, d)


def e09_gap_check(spark, d):
    return ts.gap_check(_dd(spark, d))


def g01_union_forecasts(spark, d):
    return _stand_in_forecasts(spark, d)


def i13_residual_interval(spark, d):
    reg = _reg(spark, d)
    sig = fe.tail_sigma(reg)
    return sig.select("series_id", rnd("sigma", 6).alias("sigma")).join(
        fe.tail_mean_forecast(reg, ts.future_dates(reg, HORIZON), 30), "series_id")


def i08_additive_forecast(spark, d):
    from halyard.operators import forecast_models as fm

    return fm.additive_forecast(_dd(spark, d), HORIZON)


def i09_forecast_components(spark, d):
    from halyard.operators import forecast_models as fm

    return fm.additive_forecast(_dd(spark, d), HORIZON, components=True)


def i10_arima_forecast(spark, d):
    from halyard.operators import forecast_models as fm

    return fm.arima_forecast(_dd(spark, d), HORIZON)


def i11_window_forecast(spark, d):
    from halyard.operators import forecast_models as fm

    return fm.window_forecast(_dd(spark, d), HORIZON)


def i12_forecast_select(spark, d):
    from halyard.operators import forecast_models as fm

    return fm.forecast_best(_dd(spark, d), HORIZON, HOLDOUT)


def i12c_forecast_all(spark, d):
    from halyard.operators import forecast_models as fm

    return fm.forecast(_dd(spark, d), HORIZON, "all")


def i12b_model_leaderboard(spark, d):
    from halyard.operators import forecast_models as fm

    return fm.holdout_evaluation(_dd(spark, d), HOLDOUT)


QUERIES = {name: fn for name, fn in list(globals().items())
           if callable(fn) and name[:1] in "bcdegi" and name[1:3].isdigit()}

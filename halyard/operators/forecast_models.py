"""Forecasting models for many series at once.

* I8/I9 additive model: the design matrix (piecewise-linear trend with
  changepoint hinges, weekly / yearly / monthly Fourier terms, windowed
  holiday indicators, standardised regressors) is built as native Spark
  columns; one MAP fit per series (Laplace prior on the slope changes) runs in
  ``applyInPandas`` after a shuffle by ``series_id``. A daily series holds one
  row per day, so each group is bounded by its date span, never by raw data
  volume.
* I10 seasonal ARIMA: per series in ``applyInPandas``; differencing by tests,
  orders by a stepwise search on AIC; psi-weight intervals.
* I11 window model: see ``residual_stack``.
* I12 runs the hold-out, metrics and per-series selection natively.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions import calendar as cal
from halyard.operators import forecast_eval as fe
from halyard.operators import residual_stack as rs
from halyard.operators import timeseries as ts
from halyard.operators.forecast_fits import arima, laplace_map, trend_spread
from halyard.session import checkpoint_dir, ship_package

KEY = "series_id"
Z90 = fe.Z90

# ----------------------------------------------------------- design matrix
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
SEASONALITIES = (("weekly", 7.0, 3), ("yearly", 365.25, 10), ("monthly", 30.5, 5))
REGRESSORS = ("is_promo", "is_holiday", "is_weekend", "marketing_spend", "discount_pct")
# Prior scales of the studied model (of y scaled to 1).
CHANGEPOINT_SCALE, SEASONALITY_SCALE, HOLIDAY_SCALE, REGRESSOR_SCALE, SLOPE_SCALE = 0.05, 10.0, 10.0, 10.0, 5.0

FORECAST_SCHEMA = T.StructType([
    T.StructField(KEY, T.StringType()), T.StructField("ds", T.DateType()),
    T.StructField("yhat", T.DoubleType()), T.StructField("yhat_lower", T.DoubleType()),
    T.StructField("yhat_upper", T.DoubleType()), T.StructField("model", T.StringType()),
])


def _holiday_names():
    return [n for n, _, _ in cal.HOLIDAY_EVENTS]


FLAGS, NUMERICS = ("is_promo", "is_holiday", "is_weekend"), ("marketing_spend", "discount_pct")


def supplied_regressors(future: DataFrame | None, dd: DataFrame) -> DataFrame:
    """The caller's regressors of future days as (series, ds, REGRESSORS);
    columns that aren't there are null. No series column: they hold for all."""
    if future is None:
        return dd.limit(0).select(KEY, "ds", *[F.lit(None).cast("double").alias(r) for r in REGRESSORS])
    have = [F.col(r).cast("double").alias(r) if r in future.columns else F.lit(None).cast("double").alias(r) for r in REGRESSORS]
    if KEY in future.columns:
        return future.select(KEY, "ds", *have)
    return future.select("ds", *have).crossJoin(dd.select(KEY).distinct())  # a row per series and future day


def model_frame(dd: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
    """History (regularised daily y) plus ``horizon`` future days per series,
    with regressors: observed where known, calendar flags recomputed for
    every day, numerics filled by the C1 rule. ``future`` supplies
    regressors of future days, which come before both rules."""
    reg = ts.regularize_daily(dd)
    hist = reg.join(dd.select(KEY, "ds", "marketing_spend", "discount_pct"), [KEY, "ds"], "left")
    fut = ts.future_dates(reg, horizon).select(KEY, "ds", F.lit(None).cast("double").alias("y"))
    supplied = supplied_regressors(future, dd)
    given = {f: f"_given_{f}" for f in FLAGS}
    fut = ts.with_regressors(fut, supplied.select(KEY, "ds", *NUMERICS), dd, [], list(NUMERICS))
    fut = fut.join(supplied.select(KEY, "ds", *[F.col(f).alias(n) for f, n in given.items()]), [KEY, "ds"], "left")
    hist = hist.select(KEY, "ds", "y", *NUMERICS, *[F.lit(None).cast("double").alias(n) for n in given.values()], F.lit(False).alias("is_future"))
    fut = fut.select(KEY, "ds", "y", *NUMERICS, *given.values(), F.lit(True).alias("is_future"))
    x = hist.unionByName(fut)
    means = dd.groupBy(KEY).agg(F.avg("marketing_spend").alias("_ms"), F.avg("discount_pct").alias("_dp"))
    x = x.join(means, KEY, "left").withColumns({
        "marketing_spend": F.coalesce("marketing_spend", "_ms"),
        "discount_pct": F.coalesce("discount_pct", "_dp"),
        "is_promo": F.coalesce(given["is_promo"], cal.is_promo("ds").cast("double")),
        "is_holiday": F.coalesce(given["is_holiday"], cal.is_holiday("ds").cast("double")),
        "is_weekend": F.coalesce(given["is_weekend"], cal.is_weekend("ds").cast("double")),
    }).drop("_ms", "_dp", *given.values())
    return x


def additive_design(frame: DataFrame) -> tuple[DataFrame, dict]:
    """Add the additive model's columns; returns (frame, blocks) where
    blocks maps a component name to its column names."""
    spark = frame.sparkSession
    hist = frame.filter(~F.col("is_future"))
    bounds = hist.groupBy(KEY).agg(F.min("ds").alias("_start"), F.max("ds").alias("_end"),
                                   *[F.avg(r).alias(f"_m_{r}") for r in REGRESSORS],
                                   *[F.stddev_samp(r).alias(f"_s_{r}") for r in REGRESSORS])
    x = frame.join(bounds, KEY)
    span = F.greatest(F.datediff("_end", "_start"), F.lit(1))
    t = F.datediff("ds", "_start") / span
    day = F.datediff("ds", F.lit("1970-01-01").cast("date")).cast("double")
    cols, blocks = {"t": t}, {"trend": ["t"]}
    for j in range(1, N_CHANGEPOINTS + 1):
        s = CHANGEPOINT_RANGE * j / (N_CHANGEPOINTS + 1)
        cols[f"cp{j}"] = F.greatest(F.lit(0.0), t - F.lit(s))
        blocks["trend"].append(f"cp{j}")
    for name, period, order in SEASONALITIES:
        blocks[name] = []
        for k in range(1, order + 1):
            ang = day * F.lit(2 * math.pi * k / period)
            cols[f"{name}_s{k}"], cols[f"{name}_c{k}"] = F.sin(ang), F.cos(ang)
            blocks[name] += [f"{name}_s{k}", f"{name}_c{k}"]
    for r in REGRESSORS:
        sd = F.col(f"_s_{r}")
        cols[f"reg_{r}"] = F.when(sd > 0, (F.col(r) - F.col(f"_m_{r}")) / sd).otherwise(F.lit(0.0))
    blocks["regressors"] = [f"reg_{r}" for r in REGRESSORS]
    x = x.withColumns(cols)
    # windowed holidays: each holiday is expanded over its window days into a
    # (ds -> indicator columns) table bounded by events x years x width; it
    # is pivoted on its own and broadcast, so the design frame is not re-read
    span = frame.agg(F.struct(F.min(F.year("ds")).alias("a"), F.max(F.year("ds")).alias("b"))).scalar()
    calendar = ts.holiday_calendar(spark, span.getField("a"), span.getField("b"))
    names = _holiday_names()
    days = calendar.select("holiday", F.explode(F.sequence("lower_window", "upper_window")).alias("o"),
                           F.col("ds").alias("hds")).select("holiday", F.date_add("hds", F.col("o")).alias("ds"))
    hol = days.groupBy("ds").pivot("holiday", names).agg(F.max(F.lit(1.0)))
    hcols = [f"hol_{i}" for i in range(len(names))]
    hol = hol.select("ds", *[F.col(f"`{n}`").alias(h) for n, h in zip(names, hcols)])
    x = x.join(F.broadcast(hol), "ds", "left").fillna(0.0, subset=hcols)
    blocks["holidays"] = hcols
    keep = [KEY, "ds", "y", "is_future"] + [c for b in blocks.values() for c in b]
    return x.select(*keep), blocks


def short_seasons(days: int, blocks: dict) -> dict:
    """The seasons (name to columns) that take part only in longer histories."""
    return {n: blocks[n] for n, period, _ in SEASONALITIES if days < 2 * period}


def additive_forecast(dd: DataFrame, horizon: int = 30, components: bool = False, future: DataFrame | None = None,
                      changepoint_scale: float = CHANGEPOINT_SCALE, seasonality_scale: float = SEASONALITY_SCALE,
                      holiday_scale: float = HOLIDAY_SCALE, regressor_scale: float = REGRESSOR_SCALE) -> DataFrame:
    """I8 (and I9 with ``components=True``): per-series MAP fit of the
    additive design. The slope may change at N_CHANGEPOINTS dates, with a
    Laplace prior that leaves most changes at zero; the scales are those of
    the priors. 90 % interval from the residuals and, ahead, from the trend's
    own uncertainty. ``future`` supplies regressors of future days."""
    design, blocks = additive_design(model_frame(dd, horizon, future))
    ship_package(dd.sparkSession)
    # the design frame feeds its own statistics and the per-series fits: a
    # reliable checkpoint in the shared folder builds it once
    checkpoint_dir(dd.sparkSession)
    design = design.checkpoint(eager=True)
    feat_cols = [c for b in blocks.values() for c in b]
    names = list(blocks)
    comp_fields = [T.StructField(n, T.DoubleType()) for n in names]
    scale_of = {"trend": SLOPE_SCALE, "regressors": regressor_scale, "holidays": holiday_scale}
    scales = np.array([np.inf, *[scale_of.get(n, seasonality_scale) for n in names for _ in blocks[n]]])
    sparse = np.array([False, *[c.startswith("cp") for c in feat_cols]])
    scales[sparse] = changepoint_scale
    schema = T.StructType(list(FORECAST_SCHEMA.fields) + [T.StructField("is_future", T.BooleanType()),
                                                          T.StructField("intercept", T.DoubleType())] + comp_fields)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return _fit(pdf)
        except (np.linalg.LinAlgError, ValueError):  # this series errored: no rows, of the declared types
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})

    def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        X = pdf[feat_cols].to_numpy(dtype=float)
        h = ~pdf["is_future"].to_numpy(dtype=bool)
        y = pdf["y"].to_numpy(dtype=float)
        scale = max(np.nanmax(np.abs(y[h])), 1.0) if h.any() else 1.0
        whole = np.column_stack([np.ones(len(X)), X])
        # a season that the history doesn't show twice can't be told from the trend
        for n, cols in short_seasons(int(h.sum()), blocks).items():
            whole[:, 1 + np.flatnonzero(np.isin(feat_cols, cols))] = 0.0
        beta, _ = laplace_map(whole[h], y[h] / scale, sparse, scales)
        yhat = whole @ beta * scale
        resid = y[h] - yhat[h]
        sigma = float(np.std(resid, ddof=1)) if h.sum() > 1 else 0.0
        t = pdf["t"].to_numpy(dtype=float)
        spread = np.hypot(sigma, trend_spread(beta[sparse], t - 1.0) * scale)
        out = pd.DataFrame({KEY: pdf[KEY].to_numpy(), "ds": pdf["ds"].to_numpy(), "yhat": yhat,
                            "yhat_lower": yhat - Z90 * spread, "yhat_upper": yhat + Z90 * spread,
                            "model": "Prophet", "is_future": ~h, "intercept": beta[0] * scale})
        off = 1
        for n in names:
            k = len(blocks[n])
            out[n] = whole[:, off:off + k] @ beta[off:off + k] * scale
            off += k
        return out

    res = design.groupBy(KEY).applyInPandas(fit, schema)
    if components:
        return res.filter(~F.col("is_future")).select(KEY, "ds", "yhat", "intercept", *names)
    return fe.postprocess(res.filter(F.col("is_future")).select(*FORECAST_SCHEMA.fieldNames()))


# ------------------------------------------------------------------ ARIMA
TAIL_DAYS, FALLBACK_ORDER = 7, "tail_mean"


def _tail_mean(y: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecast of a series that no model fits: the mean of its last days,
    with their spread."""
    tail = y[~np.isnan(y)][-TAIL_DAYS:]
    level = float(tail.mean()) if len(tail) else 0.0
    spread = float(tail.std(ddof=1)) if len(tail) > 1 else 0.0
    return np.full(horizon, level), np.full(horizon, spread)


def arima_forecast(dd: DataFrame, horizon: int = 30) -> DataFrame:
    """Seasonal ARIMA (m = 7) per series, differencing and orders chosen
    by test and AIC, 90 % intervals. A series that
    the model can't fit gets the tail mean, named so in ``order``."""
    ship_package(dd.sparkSession)
    reg = ts.regularize_daily(dd).select(KEY, "ds", "y")
    schema = T.StructType(list(FORECAST_SCHEMA.fields) + [T.StructField("order", T.StringType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        y = pdf["y"].to_numpy(dtype=float)
        try:
            yf, se, order = arima(y, horizon)
        except (np.linalg.LinAlgError, ValueError):  # too short or degenerate for the model
            yf, se, order = *_tail_mean(y, horizon), FALLBACK_ORDER
        last = pd.Timestamp(pdf["ds"].iloc[-1])
        days = [(last + pd.Timedelta(days=i)).date() for i in range(1, horizon + 1)]
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "ds": days, "yhat": yf, "yhat_lower": yf - Z90 * se,
                             "yhat_upper": yf + Z90 * se, "model": "ARIMA", "order": str(order)})

    return fe.postprocess(reg.groupBy(KEY).applyInPandas(fit, schema))


# ------------------------------------------------------------ window model
def window_forecast(dd: DataFrame, horizon: int = 30, lookback: int | None = None, blocks: int = rs.BLOCKS,
                    n_features: int = rs.FEATURES, seed: int = rs.SEED) -> DataFrame:
    """Direct multi-horizon forecast of a doubly residual stack trained
    on the windows of all series; a series shorter than the look-back (5 x
    horizon) gets the mean of its last days. Interval = yhat +- 1.645 * 0.5 *
    std(last 60 days)."""
    reg = ts.regularize_daily(dd).select(KEY, "ds", "y")
    series, stack = rs.train(reg, horizon, lookback, blocks, n_features, seed)
    pts = rs.predict(series, stack)
    short = series if not stack.heads else series.filter(F.size("y") < stack.lookback)
    tail = F.slice("y", F.greatest(F.lit(1), F.size("y") - TAIL_DAYS + 1), TAIL_DAYS)
    mean = F.aggregate(tail, F.lit(0.0), lambda a, y: a + y, lambda a: a / F.size(tail))
    days = F.explode(F.sequence(F.date_add("ds", 1), F.date_add("ds", horizon)))
    pts = pts.unionByName(short.select(KEY, mean.alias("yhat"), days.alias("ds")))
    return fe.residual_interval(pts, fe.tail_sigma(reg), "N-BEATS")


# ------------------------------------------------------------- selection
MODELS = {"Prophet": additive_forecast, "ARIMA": arima_forecast, "N-BEATS": window_forecast}


def holdout_evaluation(dd: DataFrame, holdout: int = 30, models=("Prophet", "ARIMA", "N-BEATS")) -> DataFrame:
    """I12 (evaluation half): fit every model on all but the last
    ``holdout`` days of each series, score the hold-out (D29), record each
    model's fit time and rank (D30). Errors are isolated: a series a model
    cannot fit gets no row for it, a model that fails as a whole gets error
    rows with null metrics; neither can be chosen."""
    import time

    # a short series keeps a day to learn from: it holds out n - 1 days at most
    reg = ts.regularize_daily(dd)
    back = Window.partitionBy(KEY)
    held = F.least(F.lit(holdout), F.count(F.lit(1)).over(back) - 1)
    last = F.row_number().over(back.orderBy(F.desc("ds"))) <= held
    reg = reg.withColumn("split", F.when(last, "test").otherwise("train"))
    # train on the regular series (so it ends the day before the hold-out
    # even when that day had no orders), with regressors where observed
    train = reg.filter(F.col("split") == "train").select(KEY, "ds", "y").join(
        dd.select(KEY, "ds", *REGRESSORS), [KEY, "ds"], "left")
    test = reg.filter(F.col("split") == "test").select(KEY, "ds", "y")
    series = dd.select(KEY).distinct()
    checkpoint_dir(dd.sparkSession)
    parts = []
    for m in models:
        t0 = time.perf_counter()
        try:
            fc = MODELS[m](train, holdout).checkpoint(eager=True)
            met = fe.forecast_metrics(fc, test).withColumns(
                {"fit_time_s": F.lit(round(time.perf_counter() - t0, 3)), "error": F.lit(None).cast("string")})
        except Exception as e:  # the whole model failed: keep the others
            met = series.select(KEY, F.lit(m).alias("model"), *[F.lit(None).cast("double").alias(c)
                                                               for c in ("mae", "rmse", "mape")],
                                F.lit(None).cast("long").alias("n_test"), F.lit(None).cast("double").alias("fit_time_s"),
                                F.lit(f"{type(e).__name__}: {str(e)[:200]}").alias("error"))
        parts.append(met)
    metrics = reduce(lambda a, b: a.unionByName(b), parts)
    return fe.pick_best_model(metrics)


def best_models(leaderboard: DataFrame, series: DataFrame) -> DataFrame:
    """(series, model): the best of each series; the default model for one
    that has no metrics, such as a series of one day."""
    best = leaderboard.filter(F.col("is_best")).select(KEY, "model")
    return series.select(KEY).distinct().join(best, KEY, "left").select(KEY, F.coalesce("model", F.lit(fe.DEFAULT_MODEL)).alias("model"))


def with_fallback(forecasts: DataFrame, dd: DataFrame, wanted: DataFrame, horizon: int) -> DataFrame:
    """``forecasts`` and, for every (series, model) of ``wanted`` that has
    none, the mean of the series' last days."""
    missing = wanted.join(forecasts.select(KEY, "model").distinct(), [KEY, "model"], "left_anti")
    reg = ts.regularize_daily(dd).select(KEY, "ds", "y").join(missing.select(KEY).distinct(), KEY, "left_semi")
    rn = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("ds")))
    tail = reg.withColumn("_rn", rn).filter(F.col("_rn") <= TAIL_DAYS).groupBy(KEY).agg(
        F.coalesce(F.avg("y"), F.lit(0.0)).alias("yhat"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("_s"), F.max("ds").alias("_end"))
    days = tail.select(KEY, "yhat", "_s", F.explode(F.sequence(F.date_add("_end", 1), F.date_add("_end", horizon))).alias("ds"))
    rows = days.join(missing, KEY).select(KEY, "ds", "yhat", (F.col("yhat") - Z90 * F.col("_s")).alias("yhat_lower"), (F.col("yhat") + Z90 * F.col("_s")).alias("yhat_upper"), "model")
    return fe.union_forecasts(forecasts, fe.postprocess(rows))


def forecast(dd: DataFrame, horizon: int = 30, mode: str = "best", holdout: int = 30, models=("Prophet", "ARIMA", "N-BEATS"),
             future: DataFrame | None = None) -> DataFrame:
    """``horizon`` days of every series, however short, by its own best
    model (``best``), by one named model, or by each (``all``). A series that
    a model can't fit has the mean of its last days, under that model's name.
    ``future`` supplies regressors to the models that take them."""
    checkpoint_dir(dd.sparkSession)
    series = dd.select(KEY).distinct()
    if mode == "best":
        wanted = best_models(holdout_evaluation(dd, holdout, models), series).checkpoint(eager=True)
    elif mode == "all" or mode in models:
        names = F.explode(F.array(*[F.lit(m) for m in (models if mode == "all" else [mode])]))
        wanted = series.select(KEY, names.alias("model"))
    else:
        raise ValueError(f"mode is best, all or one of {models}, not {mode!r}")
    asked = models if mode in ("best", "all") else [mode]

    def by(m: str) -> DataFrame:
        # ARIMA fits each series alone: only those that chose it; the others learn from all series
        own = dd.join(wanted.filter(F.col("model") == m), KEY, "left_semi") if m == "ARIMA" else dd
        return additive_forecast(own, horizon, future=future) if m == "Prophet" else MODELS[m](own, horizon)

    every = fe.union_forecasts(*[by(m) for m in asked])
    return with_fallback(every.join(wanted, [KEY, "model"], "left_semi").select(FORECAST_SCHEMA.fieldNames()), dd, wanted, horizon)


def forecast_best(dd: DataFrame, horizon: int = 30, holdout: int = 30,
                  models=("Prophet", "ARIMA", "N-BEATS")) -> DataFrame:
    """Forecast every series with its own best model."""
    return forecast(dd, horizon, "best", holdout, models)


def metrics_documents(leaderboard: DataFrame) -> DataFrame:
    """One document per series: its best model and every model's metrics,
    fit time and error."""
    own = F.struct("mae", "rmse", "mape", "n_test", "fit_time_s", "error")
    return leaderboard.groupBy(KEY).agg(F.max(F.when(F.col("is_best"), F.col("model"))).alias("best_model"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", own)))).alias("models"))

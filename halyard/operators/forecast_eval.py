"""Forecast post-processing, evaluation and model selection (B26, I13,
D27-D30, C5, G1), the residual scale shared with the window model, and
the tail-mean forecaster (a SQL-checkable stand-in model). Everything here
is native Spark: per-(series, model) groups are bounded by the horizon.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halyard.functions.numeric import rnd
from halyard.operators import timeseries as ts

KEY = "series_id"

# ---------------------------------------------------------------------------
# Fixed values that must equal the source application's (do not edit).
Z90 = 1.645                      # two-sided 90 % normal quantile
MAPE_EPS = 1e-8
FALLBACK_SIGMA = 50.0            # residual scale when history is too short
MIN_ROWS_FOR_SIGMA = 30
MODEL_PRIORITY = ("N-BEATS", "Prophet", "ARIMA")   # tie preference
DEFAULT_MODEL = "Prophet"
# ---------------------------------------------------------------------------

FORECAST_COLS = [KEY, "ds", "yhat", "yhat_lower", "yhat_upper", "model"]


def postprocess(df: DataFrame) -> DataFrame:
    """Yhat and lower bound clipped at 0, everything rounded to 2 dp."""
    return df.withColumns({
        "yhat": rnd(F.greatest(F.col("yhat"), F.lit(0.0)), 2),
        "yhat_lower": rnd(F.greatest(F.col("yhat_lower"), F.lit(0.0)), 2),
        "yhat_upper": rnd(F.col("yhat_upper"), 2),
    })


def residual_interval(point: DataFrame, sigma: DataFrame | None, model: str) -> DataFrame:
    """Yhat (clipped at 0) +- 1.645 sigma per series, lower clipped.
    ``sigma=None`` means ``point`` already carries a ``sigma`` column."""
    j = point if sigma is None else point.join(sigma.select(KEY, "sigma"), KEY, "left")
    yhat = F.greatest(F.col("yhat"), F.lit(0.0))
    margin = F.lit(Z90) * F.coalesce(F.col("sigma"), F.lit(FALLBACK_SIGMA))
    out = j.select(KEY, "ds", yhat.alias("yhat"), (yhat - margin).alias("yhat_lower"),
                   (yhat + margin).alias("yhat_upper"), F.lit(model).alias("model"))
    return postprocess(out)


def _sigma_col() -> F.Column:
    return F.when(F.col("n_rows") > MIN_ROWS_FOR_SIGMA, F.col("tail_sigma")).otherwise(F.lit(FALLBACK_SIGMA))


def tail_sigma(history: DataFrame, k_std: int = 60) -> DataFrame:
    """Residual scale: 0.5 x std of the last ``k_std`` rows when the series
    has more than 30 rows, else the fallback constant."""
    return ts.tail_profile(history, (), k_std).select(KEY, _sigma_col().alias("sigma"))


def tail_mean_forecasts(history: DataFrame, dates: DataFrame, ks=(30,)) -> DataFrame:
    """Fallback forecasters: for each k, the mean of the last k rows for
    every requested date, with the residual interval of I13. One tail
    profile serves every k."""
    prof = ts.tail_profile(history, ks, 60).select(
        KEY, *[F.col(f"mean_{k}") for k in ks], _sigma_col().alias("sigma"))
    d = dates.select(KEY, "ds").join(prof, KEY, "inner")
    parts = [residual_interval(d.select(KEY, "ds", F.col(f"mean_{k}").alias("yhat"), "sigma"), None, f"tail_mean_{k}")
             for k in ks]
    return reduce(lambda a, b: a.unionByName(b), parts)


def tail_mean_forecast(history: DataFrame, dates: DataFrame, k: int = 30, name: str | None = None) -> DataFrame:
    """Fallback forecaster for one k (see ``tail_mean_forecasts``)."""
    out = tail_mean_forecasts(history, dates, (k,))
    return out if name is None else out.withColumn("model", F.lit(name))


def union_forecasts(*frames: DataFrame) -> DataFrame:
    """G1: stack model outputs (by column name)."""
    return reduce(lambda a, b: a.unionByName(b), [f.select(*FORECAST_COLS) for f in frames])


def align_models(forecasts: DataFrame, models: list[str]) -> DataFrame:
    """Side-by-side forecasts by date, one column per model. The pivot
    values are given, so no extra job discovers them."""
    return forecasts.groupBy(KEY, "ds").pivot("model", models).agg(F.first("yhat"))


def forecast_summary(fc: DataFrame) -> DataFrame:
    """Per (series, model): total, mean, sample std, peak and trough
    (earliest date wins ties)."""
    day = F.datediff("ds", F.lit("1970-01-01").cast("date"))
    return fc.groupBy(KEY, "model").agg(
        rnd(F.sum("yhat"), 4).alias("total"),
        rnd(F.avg("yhat"), 6).alias("mean"),
        rnd(F.stddev_samp("yhat"), 6).alias("std"),
        F.max_by("ds", F.struct(F.col("yhat"), -day)).alias("peak_day"),
        F.max("yhat").alias("peak_value"),
        F.min_by("ds", F.struct(F.col("yhat"), day)).alias("trough_day"),
        F.min("yhat").alias("trough_value"),
    )


def model_comparison_summary(fc: DataFrame) -> DataFrame:
    """Per model mean / max / total of the forecast."""
    return fc.groupBy("model").agg(
        rnd(F.avg("yhat"), 6).alias("mean_yhat"),
        F.max("yhat").alias("max_yhat"),
        rnd(F.sum("yhat"), 4).alias("total_yhat"),
    )


def forecast_metrics(pred: DataFrame, actual: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE (with the 1e-8 guard) per (series, model)."""
    j = pred.select(KEY, "ds", "model", "yhat").join(actual.select(KEY, "ds", F.col("y")), [KEY, "ds"])
    err = F.col("y") - F.col("yhat")
    return j.groupBy(KEY, "model").agg(
        rnd(F.avg(F.abs(err)), 3).alias("mae"),
        rnd(F.sqrt(F.avg(err * err)), 3).alias("rmse"),
        rnd(F.avg(F.abs(err / (F.col("y") + F.lit(MAPE_EPS)))) * 100, 3).alias("mape"),
        F.count(F.lit(1)).alias("n_test"),
    )


def pick_best_model(metrics: DataFrame, priority=MODEL_PRIORITY, default: str = DEFAULT_MODEL) -> DataFrame:
    """Leaderboard per series; best = lowest MAPE, ties broken by
    ``priority``; models without a MAPE (errored) are never chosen; a series
    where every model errored gets ``default``."""
    prio = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("model"))
    prio = F.when(prio == 0, F.lit(len(priority) + 1)).otherwise(prio)
    ok = F.col("mape").isNotNull() & ~F.isnan("mape")
    w = W.partitionBy(KEY).orderBy(F.when(ok, 0).otherwise(1), F.col("mape").asc_nulls_last(), prio, F.col("model"))
    lb = metrics.withColumns({"rank": F.row_number().over(w), "_ok": ok})
    # valid models sort first, so the best is rank 1 whenever one is valid;
    # a window over the (few) models of a series, not a group-by + join
    best = F.max(F.when((F.col("rank") == 1) & F.col("_ok"), F.col("model"))).over(W.partitionBy(KEY))
    lb = lb.withColumn("best_model", F.coalesce(best, F.lit(default))).drop("_ok")
    return lb.withColumn("is_best", F.col("model") == F.col("best_model"))

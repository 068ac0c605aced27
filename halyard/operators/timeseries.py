"""Time-series shaping over (series_id, ds) daily frames: regularisation,
hold-out, lags, tail statistics, supervised windows, future dates, gap
checks, calendar joins and regressor joins.

Scale note: these operators take *daily aggregates*, so a series holds at
most one row per calendar day whatever the raw data volume; per-series
windows are therefore bounded by the date span, and Spark spreads series
over tasks. Supervised windows are built by date arithmetic + group-by, not
by collecting a whole series into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.functions import calendar as cal
from halyard.operators.quantiles import exact_quantiles

KEY = "series_id"


def _w(desc: bool = False):
    return W.partitionBy(KEY).orderBy(F.col("ds").desc() if desc else F.col("ds"))


def regularize_daily(df: DataFrame, value: str = "y") -> DataFrame:
    """E5: insert missing days and forward-fill ``value``.

    Each observed row is expanded over the days up to (not including) the
    next observed day of its series; no join and no global sort needed.
    """
    nxt = F.lead("ds").over(_w())
    x = df.select(KEY, "ds", value).withColumn("_next", nxt)
    last = F.coalesce(F.date_sub("_next", 1), F.col("ds"))
    x = x.withColumn("_d", F.explode(F.sequence(F.col("ds"), last)))
    return x.select(KEY, F.col("_d").alias("ds"), F.col(value).alias(value), (F.col("_d") != F.col("ds")).alias("is_filled"))


def time_holdout(df: DataFrame, k: int = 30) -> DataFrame:
    """The last ``k`` rows of every series are 'test', the rest 'train'."""
    rn = F.row_number().over(_w(desc=True))
    return df.withColumn("split", F.when(rn <= k, F.lit("test")).otherwise(F.lit("train")))


def event_carryover(df: DataFrame) -> DataFrame:
    """Yesterday was a holiday or promotion (first day: false) and the
    implied next-day lift."""
    ev = (F.col("is_holiday") | F.col("is_promo"))
    prev = F.lag(ev, 1, False).over(_w())
    return df.select(KEY, "ds", prev.alias("carryover")).withColumn(
        "lift", F.when(F.col("carryover"), F.lit(cal.CARRYOVER_LIFT)).otherwise(F.lit(1.0)))


def tail_profile(df: DataFrame, ks=(30,), k_std: int = 60, value: str = "y") -> DataFrame:
    """Per series, in ONE windowed aggregate: the mean of the last k rows
    for every k in ``ks`` (columns ``mean_<k>``), half the sample std of the
    last ``k_std`` rows (``tail_sigma``), the rows kept (``n_tail``) and the
    series length (``n_rows``)."""
    w = _w(desc=True)
    x = df.select(KEY, value, F.row_number().over(w).alias("_rn"),
                  F.count(F.lit(1)).over(W.partitionBy(KEY)).alias("_n"))
    x = x.filter(F.col("_rn") <= max(list(ks) + [k_std]))
    return x.groupBy(KEY).agg(
        *[F.avg(F.when(F.col("_rn") <= k, F.col(value))).alias(f"mean_{k}") for k in ks],
        (F.stddev_samp(F.when(F.col("_rn") <= k_std, F.col(value))) * 0.5).alias("tail_sigma"),
        F.max("_rn").alias("n_tail"),
        F.max("_n").alias("n_rows"),
    )


def tail_stats(df: DataFrame, k_mean: int = 30, k_std: int = 60, value: str = "y") -> DataFrame:
    """Per series mean of the last ``k_mean`` rows and half the sample
    std of the last ``k_std`` rows (the residual scale of the window model)."""
    p = tail_profile(df, (k_mean,), k_std, value)
    return p.select(KEY, F.col(f"mean_{k_mean}").alias("tail_mean"), "tail_sigma",
                    F.least(F.col("n_tail"), F.lit(max(k_mean, k_std))).alias("n_tail"))


def supervised_windows(reg: DataFrame, lookback: int, horizon: int, value: str = "y") -> DataFrame:
    """Every complete (lookback, horizon) pair of a regular daily series.

    One shuffle of the rows by series; each row's window is a frame of
    ``lookback + horizon`` rows. A series holds one row per day, so its
    partition is bounded by its dates.
    """
    held = F.struct(F.col(value).alias("v"))  # a struct is kept where its value is null
    def frame(a: int, b: int):
        return F.collect_list(held).over(W.partitionBy(KEY).orderBy("ds").rowsBetween(a, b))

    x = reg.select(KEY, "ds", frame(1 - lookback, 0).alias("_l"), frame(1, horizon).alias("_h"))
    x = x.filter((F.size("_l") == lookback) & (F.size("_h") == horizon))
    return x.select(KEY, "ds", F.transform("_l", lambda p: p["v"]).alias("lookback"), F.transform("_h", lambda p: p["v"]).alias("horizon"))


def future_dates(df: DataFrame, h: int) -> DataFrame:
    """The next ``h`` days after each series' last day."""
    last = df.groupBy(KEY).agg(F.max("ds").alias("_last"))
    return last.select(
        KEY, F.posexplode(F.sequence(F.date_add("_last", 1), F.date_add("_last", h))).alias("_i", "ds")
    ).select(KEY, "ds", (F.col("_i") + 1).alias("step"))


def gap_check(df: DataFrame) -> DataFrame:
    """Per series, rows, gaps (consecutive dates not one day apart),
    the largest gap and whether the series is regular."""
    gap = F.datediff("ds", F.lag("ds").over(_w()))
    x = df.select(KEY, gap.alias("_gap"))
    return x.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_gap") != 1).alias("n_gaps"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("max_gap"),
    ).withColumn("is_regular", F.col("n_gaps") == 0)


def rolling_mean(df: DataFrame, value: str, order: str, periods: int = 3, partition: list[str] | None = None) -> DataFrame:
    """Trailing mean over ``periods`` rows (min_periods = 1).

    Meant for already-aggregated periods (timelines); pass ``partition``
    whenever there is more than one timeline.
    """
    w = (W.partitionBy(*partition) if partition else W.partitionBy()).orderBy(order).rowsBetween(-(periods - 1), 0)
    return df.withColumn("trend", F.avg(value).over(w))


def holiday_calendar(spark, first_year: int | F.Column, last_year: int | F.Column) -> DataFrame:
    """The additive model's holiday table (holiday, ds, lower_window,
    upper_window) for a span of years, generated from the event rule."""
    ev = spark.createDataFrame(
        [(n, md, -lw, cal.HOLIDAY_UPPER_WINDOW) for n, md, lw in cal.HOLIDAY_EVENTS],
        "holiday string, md string, lower_window int, upper_window int")
    fy = first_year if isinstance(first_year, F.Column) else F.lit(first_year)
    ly = last_year if isinstance(last_year, F.Column) else F.lit(last_year)
    years = ev.withColumn("year", F.explode(F.sequence(fy, ly)))
    return years.select(
        "holiday",
        F.to_date(F.concat_ws("-", F.col("year").cast("string"), F.col("md"))).alias("ds"),
        "lower_window", "upper_window")


def holiday_window_join(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Day d matches holiday h when h.ds + lower <= d <= h.ds + upper.

    The range condition is turned into an equi-join by expanding each
    holiday over its (few) window days; the expanded calendar is bounded by
    events x years x window width, so it is broadcast.
    """
    days = calendar.select(
        "holiday", F.col("ds").alias("holiday_ds"),
        F.explode(F.sequence("lower_window", "upper_window")).alias("offset"),
    ).withColumn("ds", F.date_add("holiday_ds", F.col("offset")))
    return df.join(F.broadcast(days), "ds", "inner")


def with_regressors(future: DataFrame, supplied: DataFrame, history: DataFrame,
                    flags: list[str], numerics: list[str], tail: int = 30) -> DataFrame:
    """Future dates left-joined to supplied regressors.

    Missing flags become 0; a missing numeric takes the mean of the values
    supplied for that series' future frame, and when none was supplied the
    mean of the series' last ``tail`` history rows. The per-series window
    spans the forecast horizon only.
    """
    rn = F.row_number().over(_w(desc=True))
    tails = (history.select(KEY, *numerics, rn.alias("_rn")).filter(F.col("_rn") <= tail)
             .groupBy(KEY).agg(*[F.avg(c).alias(f"_tail_{c}") for c in numerics]))
    j = future.join(supplied.select(KEY, "ds", *flags, *numerics), [KEY, "ds"], "left").join(tails, KEY, "left")
    wf = W.partitionBy(KEY)
    cols = [F.col(KEY), F.col("ds")] + [c for c in future.columns if c not in (KEY, "ds")]
    cols += [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in flags]
    cols += [F.coalesce(F.col(n), F.avg(n).over(wf), F.col(f"_tail_{n}")).alias(n) for n in numerics]
    return j.select(*cols)


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count / mean / std / min / quartiles / max per column, long form.

    Quartiles are exact (linear interpolation), found by narrowing intervals.
    """
    found = exact_quantiles(df, [F.col(c) for c in cols], [0.25, 0.5, 0.75])
    aggs = []
    for c, q in zip(cols, found):
        x = F.col(c).cast("double")
        aggs.append(F.struct(
            F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
            *[F.lit(v).cast("double").alias(n) for v, n in zip(q, ("q25", "q50", "q75"))], F.max(x).alias("max")).alias(c))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column, s)").select("column", "s.*")

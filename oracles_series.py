"""DuckDB oracles for the demand-series queries."""

from __future__ import annotations

from halyard.functions import calendar as cal
from oracles import DD, _w

REG = DD + """,
bounds AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM dd GROUP BY 1),
grid AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM bounds),
reg AS (
  SELECT g.series_id, g.ds,
    last_value(d.y IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ds
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y,
    d.y IS NULL AS is_filled
  FROM grid g LEFT JOIN dd d ON g.series_id = d.series_id AND g.ds = d.ds
)"""


def _fut(src: str = "reg", h: int = 30, name: str = "fut") -> str:
    return f""",
{name} AS (
  SELECT b.series_id, CAST(b.hi + CAST(t.s AS INTEGER) AS DATE) AS ds, CAST(t.s AS INTEGER) AS step
  FROM (SELECT series_id, max(ds) AS hi FROM {src} GROUP BY 1) b, range(1, {h + 1}) t(s)
)"""


def _tail(src: str, name: str, k_mean: int, k_std: int = 60) -> str:
    return f""",
{name}_rn AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM {src}),
{name} AS (
  SELECT series_id, avg(y) FILTER (WHERE rn <= {k_mean}) AS tail_mean,
    stddev_samp(y) FILTER (WHERE rn <= {k_std}) * 0.5 AS tail_sigma, CAST(max(rn) AS INTEGER) AS n_tail
  FROM {name}_rn WHERE rn <= {max(k_mean, k_std)} GROUP BY 1
)"""


def _sigma(src: str, name: str) -> str:
    return _tail(src, name + "_t60", 60, 60) + f""",
{name} AS (
  SELECT t.series_id, CASE WHEN n.n > 30 THEN t.tail_sigma ELSE 50.0 END AS sigma
  FROM {name}_t60 t JOIN (SELECT series_id, count(*) AS n FROM {src} GROUP BY 1) n ON t.series_id = n.series_id
)"""


def _tail_fc(src: str, dates: str, k: int, name: str) -> str:
    """Tail-mean forecast of ``src`` for the rows of ``dates``."""
    return _tail(src, f"{name}_tm", k) + _sigma(src, f"{name}_sg") + f""",
{name} AS (
  SELECT d.series_id, d.ds,
    round(greatest(greatest(t.tail_mean, 0.0), 0.0), 2) AS yhat,
    round(greatest(greatest(t.tail_mean, 0.0) - 1.645 * coalesce(s.sigma, 50.0), 0.0), 2) AS yhat_lower,
    round(greatest(t.tail_mean, 0.0) + 1.645 * coalesce(s.sigma, 50.0), 2) AS yhat_upper,
    'tail_mean_{k}' AS model
  FROM {dates} d JOIN {name}_tm t ON d.series_id = t.series_id
  LEFT JOIN {name}_sg s ON d.series_id = s.series_id
)"""


STAND_IN = REG + _fut() + _tail_fc("reg", "fut", 7, "f7") + _tail_fc("reg", "fut", 30, "f30") + """,
fc AS (SELECT * FROM f7 UNION ALL SELECT * FROM f30)"""

HOLDOUT = REG + """,
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 30
  THEN 'test' ELSE 'train' END AS split FROM reg),
train AS (SELECT * FROM sp WHERE split = 'train'),
test AS (SELECT * FROM sp WHERE split = 'test')""" + _tail_fc("train", "test", 7, "h7") + _tail_fc(
    "train", "test", 30, "h30") + """,
hfc AS (SELECT * FROM h7 UNION ALL SELECT * FROM h30),
metrics AS (
  SELECT f.series_id, f.model, round(avg(abs(t.y - f.yhat)), 3) AS mae,
    round(sqrt(avg((t.y - f.yhat) * (t.y - f.yhat))), 3) AS rmse,
    round(avg(abs((t.y - f.yhat) / (t.y + 1e-8))) * 100, 3) AS mape, count(*) AS n_test
  FROM hfc f JOIN test t ON f.series_id = t.series_id AND f.ds = t.ds GROUP BY 1, 2
)"""

_EVENTS = ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', '{md}', {-lw}, {cal.HOLIDAY_UPPER_WINDOW})"
                    for n, md, lw in cal.HOLIDAY_EVENTS)

SERIES_SQL = {
    "b23_calendar_features": _w(DD, "SELECT series_id, ds, day_of_week, month, week_of_year, is_weekend FROM dd"),
    "b24_event_flags": _w(DD, "SELECT series_id, ds, is_holiday, is_promo FROM dd"),
    "b25_net_revenue": _w(DD, "SELECT series_id, ds, round(y * avg_order_value * (1.0 - discount_pct), 4) AS net_revenue FROM dd"),
    "b26_postprocess_forecast": _w(HOLDOUT, "SELECT * FROM hfc"),
    "c01_regressor_join": _w(REG + _fut(), """,
sup AS (SELECT series_id, CAST(ds + 364 AS DATE) AS ds, is_promo, is_holiday, is_weekend, marketing_spend, discount_pct FROM dd),
tails AS (
  SELECT series_id, avg(marketing_spend) AS t_ms, avg(discount_pct) AS t_dp
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM dd) WHERE rn <= 30 GROUP BY 1
),
j AS (
  SELECT f.series_id, f.ds, f.step, s.is_promo, s.is_holiday, s.is_weekend, s.marketing_spend, s.discount_pct, t.t_ms, t.t_dp
  FROM fut f LEFT JOIN sup s ON f.series_id = s.series_id AND f.ds = s.ds LEFT JOIN tails t ON f.series_id = t.series_id
)
SELECT series_id, ds, step,
  coalesce(CAST(is_promo AS DOUBLE), 0.0) AS is_promo, coalesce(CAST(is_holiday AS DOUBLE), 0.0) AS is_holiday,
  coalesce(CAST(is_weekend AS DOUBLE), 0.0) AS is_weekend,
  round(coalesce(marketing_spend, avg(marketing_spend) OVER (PARTITION BY series_id), t_ms), 6) AS marketing_spend,
  round(coalesce(discount_pct, avg(discount_pct) OVER (PARTITION BY series_id), t_dp), 6) AS discount_pct
FROM j"""),
    "c03_holiday_window_join": _w(DD, f""",
ev(holiday, md, lower_window, upper_window) AS (VALUES {_EVENTS}),
yrs AS (SELECT CAST(unnest(range(min(year(ds)), max(year(ds)) + 1)) AS INTEGER) AS year FROM dd),
calendar AS (
  SELECT holiday, CAST(strptime(CAST(year AS VARCHAR) || '-' || md, '%Y-%m-%d') AS DATE) AS ds, lower_window, upper_window
  FROM ev, yrs
),
days AS (
  SELECT holiday, ds AS holiday_ds, CAST(o.o AS INTEGER) AS offset, CAST(ds + CAST(o.o AS INTEGER) AS DATE) AS d
  FROM calendar, LATERAL (SELECT unnest(range(lower_window, upper_window + 1)) AS o) o
)
SELECT dd.series_id, dd.ds, dd.y, days.holiday, days.holiday_ds, days.offset FROM dd JOIN days ON dd.ds = days.d"""),
    "c05_model_alignment": _w(STAND_IN, """
SELECT series_id, ds, max(yhat) FILTER (WHERE model = 'tail_mean_7') AS tail_mean_7,
  max(yhat) FILTER (WHERE model = 'tail_mean_30') AS tail_mean_30 FROM fc GROUP BY 1, 2"""),
    "d27_forecast_summary": _w(STAND_IN, """
SELECT series_id, model, round(sum(yhat), 4) AS total, round(avg(yhat), 6) AS mean,
  round(stddev_samp(yhat), 6) AS std, first(ds ORDER BY yhat DESC, ds ASC) AS peak_day, max(yhat) AS peak_value,
  first(ds ORDER BY yhat ASC, ds ASC) AS trough_day, min(yhat) AS trough_value
FROM fc GROUP BY 1, 2"""),
    "d28_model_comparison_summary": _w(STAND_IN, """
SELECT model, round(avg(yhat), 6) AS mean_yhat, max(yhat) AS max_yhat, round(sum(yhat), 4) AS total_yhat
FROM fc GROUP BY 1"""),
    "d29_forecast_metrics": _w(HOLDOUT, "SELECT * FROM metrics"),
    "d30_pick_best_model": _w(HOLDOUT, """,
lb AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY
    CASE WHEN mape IS NOT NULL AND NOT isnan(mape) THEN 0 ELSE 1 END, mape ASC NULLS LAST,
    CASE model WHEN 'tail_mean_7' THEN 1 WHEN 'tail_mean_30' THEN 2 ELSE 3 END, model) AS INTEGER) AS rank
  FROM metrics
),
best AS (
  SELECT series_id, coalesce(max(CASE WHEN rank = 1 AND mape IS NOT NULL AND NOT isnan(mape) THEN model END),
    'Prophet') AS best_model FROM lb GROUP BY 1
)
SELECT lb.*, best.best_model, lb.model = best.best_model AS is_best FROM lb JOIN best ON lb.series_id = best.series_id"""),
    "d35_describe": _w(DD, "\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
        f"round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM dd"
        for c in ("y", "revenue", "avg_order_value", "marketing_spend", "discount_pct"))),
    "e02_event_carryover": _w(DD, f"""
SELECT series_id, ds, lag(is_holiday OR is_promo, 1, false) OVER (PARTITION BY series_id ORDER BY ds) AS carryover,
  CASE WHEN lag(is_holiday OR is_promo, 1, false) OVER (PARTITION BY series_id ORDER BY ds)
    THEN CAST('{cal.CARRYOVER_LIFT!r}' AS DOUBLE) ELSE 1.0 END AS lift
FROM dd"""),
    "e03_tail_stats": _w(REG + _tail("reg", "tl", 30, 60), """
SELECT series_id, round(tail_mean, 6) AS tail_mean, round(tail_sigma, 6) AS tail_sigma, n_tail FROM tl"""),
    "e04_supervised_windows": _w(REG, """
SELECT a.series_id, a.ds, list(b.y ORDER BY b.ds) FILTER (WHERE b.ds <= a.ds) AS lookback,
  list(b.y ORDER BY b.ds) FILTER (WHERE b.ds > a.ds) AS horizon
FROM reg a JOIN reg b ON a.series_id = b.series_id AND b.ds BETWEEN a.ds - 13 AND a.ds + 7
GROUP BY 1, 2 HAVING count(*) = 21"""),
    "e05_regularize_daily": _w(REG, "SELECT * FROM reg"),
    "e06_time_holdout": _w(REG, """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 30 THEN 'test' ELSE 'train' END AS split
FROM reg"""),
    "e08_future_dates": _w(REG + _fut(), "SELECT * FROM fut"),
    "e09_gap_check": _w(DD, """
SELECT series_id, count(*) AS n_rows, count(*) FILTER (WHERE gap <> 1) AS n_gaps,
  CAST(coalesce(max(gap), 0) AS INTEGER) AS max_gap, count(*) FILTER (WHERE gap <> 1) = 0 AS is_regular
FROM (SELECT series_id, ds - lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS gap FROM dd) GROUP BY 1"""),
    "g01_union_forecasts": _w(STAND_IN, "SELECT * FROM fc"),
    "i13_residual_interval": _w(REG + _fut() + _sigma("reg", "sg") + _tail_fc("reg", "fut", 30, "f30"), """
SELECT s.series_id, round(s.sigma, 6) AS sigma, f.ds, f.yhat, f.yhat_lower, f.yhat_upper, f.model
FROM sg s JOIN f30 f ON s.series_id = f.series_id"""),
}

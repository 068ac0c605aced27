"""Calendar and demand-shaping column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the source application's (do not edit).
# Month-day strings flagged as holidays and as promotion days.
HOLIDAY_MONTH_DAYS = ("01-01", "02-14", "03-25", "08-15", "10-12", "11-12", "12-25", "12-31")
PROMO_MONTH_DAYS = ("01-26", "05-15", "08-15", "10-02", "11-29", "12-02")
# Holiday calendar of the additive model: (name, month-day, days before).
# Every event also covers the day after (upper window 1).
HOLIDAY_EVENTS = (
    ("New Year", "01-01", 1),
    ("Republic Day Sale", "01-26", 2),
    ("Valentine's Day", "02-14", 1),
    ("Holi", "03-25", 1),
    ("Independence Day", "08-15", 2),
    ("Gandhi Jayanti Sale", "10-02", 1),
    ("Dussehra", "10-12", 2),
    ("Diwali", "11-12", 3),
    ("Black Friday", "11-29", 2),
    ("Cyber Monday", "12-02", 1),
    ("Christmas", "12-25", 1),
    ("New Year Eve", "12-31", 1),
)
HOLIDAY_UPPER_WINDOW = 1
# Carry-over lift of an event on the next day.
CARRYOVER_LIFT = 1 + 0.5 * 0.15
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_of_week(ds) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ds))


def is_weekend(ds) -> Column:
    return F.weekday(_c(ds)) >= 5


def month_day(ds) -> Column:
    return F.date_format(_c(ds), "MM-dd")


def is_holiday(ds) -> Column:
    return month_day(ds).isin(*HOLIDAY_MONTH_DAYS)


def is_promo(ds) -> Column:
    return month_day(ds).isin(*PROMO_MONTH_DAYS)


def net_revenue(y, aov, discount) -> Column:
    return _c(y) * _c(aov) * (F.lit(1.0) - _c(discount))

"""Column expressions for customer cleaning, segmentation and features.

All builders take and return ``Column`` objects so they stay inside
whole-stage codegen; none of them needs Python at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the source application's (do not edit):
# contract ordinal codes, the payment method treated as the risky one,
# gender codes, segment and tier cut-offs.
CONTRACT_CODES = {"Month-to-month": 0, "One year": 1, "Two year": 2}
RISKY_PAYMENT = "Electronic check"
GENDER_CODES = {"Female": 0, "Male": 1}
LONG_TERM_TENURE = 36
HIGH_VALUE_MONTHLY = 70
NEW_TENURE = 12
SPENDING_CUTS = (35, 65)
SERVING_HIGH_VALUE_CUT = 65.0
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def yes_no_to_bool(c) -> Column:
    """'Yes' -> true, 'No' -> false, anything else -> null."""
    c = _c(c)
    return F.when(c == "Yes", F.lit(True)).when(c == "No", F.lit(False))


def to_double_or_null(c) -> Column:
    """Text to double; unparsable (blank, junk) becomes null."""
    return F.trim(_c(c).cast("string")).try_cast("double")


def to_double_or_zero(c) -> Column:
    """Text to double; unparsable becomes 0 (the scoring path)."""
    return F.coalesce(to_double_or_null(c), F.lit(0.0))


def customer_segment(churn, tenure, monthly) -> Column:
    """Ordered CASE: Churned, Long-term, High-value, New, Regular."""
    churn, tenure, monthly = _c(churn), _c(tenure), _c(monthly)
    return (
        F.when(churn, "Churned")
        .when(tenure >= LONG_TERM_TENURE, "Long-term")
        .when(monthly > HIGH_VALUE_MONTHLY, "High-value")
        .when(tenure < NEW_TENURE, "New")
        .otherwise("Regular")
    )


def spending_tier(monthly) -> Column:
    monthly = _c(monthly)
    lo, hi = SPENDING_CUTS
    return F.when(monthly < lo, "Low").when(monthly < hi, "Medium").otherwise("High")


def demand_driver(is_holiday, is_promo, is_weekend) -> Column:
    return (
        F.when(_c(is_holiday), "Holiday")
        .when(_c(is_promo), "Promotion")
        .when(_c(is_weekend), "Weekend")
        .otherwise("Standard")
    )


def gender_code(c) -> Column:
    c = _c(c)
    return F.when(c == "Male", F.lit(GENDER_CODES["Male"])).otherwise(F.lit(GENDER_CODES["Female"]))


def contract_code(c) -> Column:
    c = _c(c)
    expr = F.lit(0)
    for name, code in CONTRACT_CODES.items():
        expr = F.when(c == name, F.lit(code)).otherwise(expr)
    return expr


def payment_code(c) -> Column:
    """1 for any method other than the risky one (null counts as other)."""
    c = _c(c)
    return F.when(c == RISKY_PAYMENT, F.lit(0)).otherwise(F.lit(1))


def bool_to_int(c) -> Column:
    return F.coalesce(_c(c).cast("int"), F.lit(0))


def avg_charges_per_month(total, tenure) -> Column:
    return _c(total) / (_c(tenure) + F.lit(1))


def tenure_group(tenure) -> Column:
    t = _c(tenure)
    return F.when(t <= 12, 0).when(t <= 36, 1).otherwise(2)


def tenure_group_detailed(tenure) -> Column:
    """Right-closed bins (0,6],(6,12],(12,24],(24,36],(36,100] -> 0..4; else -1."""
    t = _c(tenure)
    return (
        F.when((t > 0) & (t <= 6), 0)
        .when((t > 6) & (t <= 12), 1)
        .when((t > 12) & (t <= 24), 2)
        .when((t > 24) & (t <= 36), 3)
        .when((t > 36) & (t <= 100), 4)
        .otherwise(-1)
    )


def revenue_category(x, lo, hi) -> Column:
    """Three equal-width right-closed bins over [lo, hi] -> 0, 1, 2.

    An all-equal column (hi == lo) puts every row in the middle bin, as an
    equal-width cut over a zero-width range does.
    """
    x, lo, hi = _c(x), _c(lo), _c(hi)
    width = (hi - lo) / F.lit(3.0)
    binned = F.least(F.lit(2), F.greatest(F.lit(0), (F.ceil((x - lo) / width) - 1).cast("int")))
    return F.when(hi == lo, F.lit(1)).otherwise(binned)


def senior_with_family(senior, partner, dependents) -> Column:
    return (bool_to_int(senior) == 1) & ((bool_to_int(partner) == 1) | (bool_to_int(dependents) == 1))


def contract_tenure_interaction(contract_cd, tenure) -> Column:
    return _c(contract_cd) * _c(tenure)


def charges_tenure_ratio(monthly, tenure) -> Column:
    return _c(monthly) / (_c(tenure) + F.lit(1))


def customer_value_proxy(tenure, monthly) -> Column:
    return _c(tenure) * _c(monthly) / F.lit(100.0)

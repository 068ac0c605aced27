"""Column expressions that turn a churn probability into business outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the source application's (do not edit).
# Serving tiers: p >= 0.7 High Risk, p >= 0.4 Medium Risk, else Low Risk.
SERVING_TIERS = ((0.7, "High Risk"), (0.4, "Medium Risk"))
SERVING_DEFAULT_TIER = "Low Risk"
# Analysis bands, right-closed: (0, .3] Low, (.3, .7] Medium, (.7, 1] High.
ANALYSIS_BANDS = ((0.0, 0.3, "Low Risk"), (0.3, 0.7, "Medium Risk"), (0.7, 1.0, "High Risk"))
# Recommendation lists by lower probability bound, checked from the top.
RECOMMENDATIONS = (
    (0.8, [
        "🔴 URGENT: Immediate retention campaign required",
        "💰 Offer significant discount or upgrade incentive",
        "📞 Personal outreach from customer success team",
        "🎁 Provide exclusive benefits or early access features",
    ]),
    (0.6, [
        "⚠️  HIGH RISK: Proactive retention needed",
        "📧 Send targeted email campaign with value proposition",
        "💬 Schedule customer satisfaction survey",
        "🛠️  Provide additional support or training resources",
    ]),
    (0.4, [
        "📊 MEDIUM RISK: Monitor closely",
        "📝 Send product usage tips and best practices",
        "🤝 Invite to user community or webinars",
        "📈 Share success stories and ROI metrics",
    ]),
    (None, [
        "✅ LOW RISK: Focus on expansion opportunities",
        "🚀 Introduce premium features or add-ons",
        "🎯 Request referrals or case study participation",
        "📢 Consider as brand advocate for testimonials",
    ]),
)
# Business parameters of the threshold study.
RETENTION_COST = 50.0
CHURN_LOSS = 500.0
CAMPAIGN_SUCCESS_RATE = 0.3
SWEEP_START, SWEEP_STEP, SWEEP_COUNT = 0.10, 0.05, 16
HIGH_RISK_SCAN_THRESHOLD = 0.6
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _number(p) -> Column:
    """A probability that is NaN is unknown: in Spark NaN is above every cut."""
    p = _c(p).cast("double")
    return F.when(~F.isnan(p), p)


def risk_level(p) -> Column:
    p = _number(p)
    expr = None
    for cut, name in SERVING_TIERS:
        expr = F.when(p >= cut, name) if expr is None else expr.when(p >= cut, name)
    return expr.otherwise(SERVING_DEFAULT_TIER)


def risk_band(p) -> Column:
    """Right-closed analysis bands; p outside (0, 1] is null."""
    p = _c(p)
    expr = None
    for lo, hi, name in ANALYSIS_BANDS:
        cond = (p > lo) & (p <= hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def recommendations(p) -> Column:
    p = _number(p)
    expr = None
    default = None
    for cut, items in RECOMMENDATIONS:
        arr = F.array(*[F.lit(s) for s in items])
        if cut is None:
            default = arr
        else:
            expr = F.when(p >= cut, arr) if expr is None else expr.when(p >= cut, arr)
    return expr.otherwise(default)


def classify(p, threshold) -> Column:
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return _number(p) >= thr


def sweep_thresholds() -> list[float]:
    """The 16 studied thresholds .10, .15, ..., .85 (rounded to 2 dp)."""
    return [round(SWEEP_START + SWEEP_STEP * i, 2) for i in range(SWEEP_COUNT)]

"""Customer operators: cleaning (B1-B3), segmentation and features (B4-B15),
validation (B21-B22), joins (C2, C4, C6, C7) and KPI aggregations (D1-D19).

Every operator is DataFrame -> DataFrame. Aggregations are single-pass
``agg`` calls so Spark does partial (map-side) aggregation before the one
shuffle; global scalars (medians, min/max) are scalar subqueries computed
once, never driver loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.numeric import rnd
from halyard.functions import customer as cf
from halyard.functions import risk as rf
from halyard.operators.quantiles import exact_quantiles

# ---------------------------------------------------------------------------
# Fixed values that must equal the source application's (do not edit).
TENURE_BUCKETS = ((12, "0-12m"), (24, "13-24m"), (48, "25-48m"), (60, "49-60m"), (None, "60m+"))
CHARGE_BUCKETS = ((30, "<$30"), (50, "$30-50"), (70, "$50-70"), (90, "$70-90"), (None, ">$90"))
CORR_FEATURES = ("gender", "senior_citizen", "partner", "dependents", "tenure_months",
                 "contract", "monthly_charges", "total_charges")
DEMOGRAPHIC_FLAGS = ("female", "male", "senior_citizen", "partner", "dependents")
# ---------------------------------------------------------------------------


# ----------------------------------------------------------------- cleaning
def clean_customers(raw: DataFrame) -> DataFrame:
    """B1 + B2: rename, type and fill the raw text export."""
    tenure = F.trim("tenure").try_cast("int")
    monthly = cf.to_double_or_null("MonthlyCharges")
    total = F.coalesce(cf.to_double_or_null("TotalCharges"), monthly * tenure)
    senior = F.trim("SeniorCitizen").try_cast("int")
    return raw.select(
        F.col("customerID").alias("customer_id"),
        F.col("gender"),
        F.when(senior.isNull(), F.lit(None).cast("boolean")).otherwise(senior != 0).alias("senior_citizen"),
        cf.yes_no_to_bool("Partner").alias("partner"),
        cf.yes_no_to_bool("Dependents").alias("dependents"),
        tenure.alias("tenure_months"),
        F.col("Contract").alias("subscription_type"),
        F.col("PaymentMethod").alias("payment_method"),
        monthly.alias("monthly_charges"),
        total.alias("total_charges"),
        cf.yes_no_to_bool("Churn").alias("churn_status"),
    )


def coerce_numeric(raw: DataFrame) -> DataFrame:
    """B2: numeric text -> double (null if unparsable); missing totals filled."""
    tenure = cf.to_double_or_null("tenure")
    monthly = cf.to_double_or_null("MonthlyCharges")
    return raw.select(
        "customerID",
        tenure.alias("tenure"),
        monthly.alias("monthly_charges"),
        cf.to_double_or_null("TotalCharges").alias("total_charges_parsed"),
        F.coalesce(cf.to_double_or_null("TotalCharges"), monthly * tenure).alias("total_charges"),
    )


def coerce_or_zero(raw: DataFrame) -> DataFrame:
    """Numeric text -> double, unparsable -> 0 (scoring path)."""
    return raw.select(
        "customerID",
        cf.to_double_or_zero("tenure").alias("tenure"),
        cf.to_double_or_zero("MonthlyCharges").alias("monthly_charges"),
        cf.to_double_or_zero("TotalCharges").alias("total_charges"),
    )


# ------------------------------------------------------------- segmentation
def with_segments(cb: DataFrame) -> DataFrame:
    """B4 + B5: customer_segment and spending_tier columns."""
    return cb.withColumns({
        "customer_segment": cf.customer_segment("churn_status", "tenure_months", "monthly_charges"),
        "spending_tier": cf.spending_tier("monthly_charges"),
    })


def encode_categoricals(cb: DataFrame) -> DataFrame:
    """Model-ready integer codes."""
    return cb.select(
        "customer_id",
        cf.gender_code("gender").alias("gender"),
        cf.bool_to_int("senior_citizen").alias("senior_citizen"),
        cf.bool_to_int("partner").alias("partner"),
        cf.bool_to_int("dependents").alias("dependents"),
        F.col("tenure_months"),
        cf.contract_code("subscription_type").alias("contract"),
        cf.payment_code("payment_method").alias("payment_method"),
        F.col("monthly_charges"),
        F.col("total_charges"),
        cf.bool_to_int("churn_status").alias("churn"),
    )


def monthly_stats(cb: DataFrame):
    """Training median, min and max of monthly charges as a struct: the exact
    median by narrowing intervals, the others as one scalar subquery."""
    (median,), = exact_quantiles(cb, [F.col("monthly_charges")], [0.5])
    return cb.agg(F.struct(F.lit(median).cast("double").alias("median"),
                           F.min("monthly_charges").alias("min"),
                           F.max("monthly_charges").alias("max"))).scalar()


def engineer_features(cb: DataFrame, high_value_cut=None, charge_min=None, charge_max=None) -> DataFrame:
    """B8-B14 on the encoded frame.

    The cut and the min/max default to the frame's own statistics
    (training behaviour); scoring passes the persisted training values.
    """
    enc = encode_categoricals(cb)
    need_stats = high_value_cut is None or charge_min is None or charge_max is None
    if need_stats:
        enc = enc.withColumn("_stats", monthly_stats(cb))
    cut = F.col("_stats.median") if high_value_cut is None else F.lit(float(high_value_cut))
    lo = F.col("_stats.min") if charge_min is None else F.lit(float(charge_min))
    hi = F.col("_stats.max") if charge_max is None else F.lit(float(charge_max))
    out = enc.withColumns({
        "avg_charges_per_month": cf.avg_charges_per_month("total_charges", "tenure_months"),
        "tenure_group": cf.tenure_group("tenure_months"),
        "tenure_group_detailed": cf.tenure_group_detailed("tenure_months"),
        "is_high_value": (F.col("monthly_charges") > cut).cast("int"),
        "revenue_category": cf.revenue_category("monthly_charges", lo, hi),
        "senior_with_family": cf.senior_with_family("senior_citizen", "partner", "dependents").cast("int"),
        "contract_tenure_interaction": cf.contract_tenure_interaction("contract", "tenure_months"),
        "charges_tenure_ratio": cf.charges_tenure_ratio("monthly_charges", "tenure_months"),
        "customer_value_proxy": cf.customer_value_proxy("tenure_months", "monthly_charges"),
    })
    return out.drop("_stats") if need_stats else out


def align_features(df: DataFrame, feature_cols: list[str], keep: tuple[str, ...] = ("customer_id",)) -> DataFrame:
    """Exactly the model's columns in order; missing ones are 0."""
    have = set(df.columns)
    cols = [F.col(k) for k in keep if k in have]
    for c in feature_cols:
        cols.append((F.col(c) if c in have else F.lit(0)).cast("double").alias(c))
    return df.select(*cols)


def with_risk_outputs(scored: DataFrame, p: str = "churn_probability", threshold: float = 0.5) -> DataFrame:
    """B16-B19 on a frame with a probability column."""
    return scored.withColumns({
        "churn_prediction": rf.classify(p, threshold),
        "risk_level": rf.risk_level(p),
        "risk_band": rf.risk_band(p),
        "recommendations": rf.recommendations(p),
    })


def lookup_customer(cb: DataFrame, customer_id) -> DataFrame:
    """Parameterised point filter (pushed into the parquet scan when
    the id is a stored column)."""
    return cb.filter(F.col("customer_id") == F.lit(customer_id))


# --------------------------------------------------------------- validation
def validate_constraints(df: DataFrame, rules: dict) -> DataFrame:
    """One pass, one count per rule, long output (rule, violations).

    ``rules`` maps a rule name to a boolean Column that is TRUE for a
    *valid* row; nulls in the checked column count as violations.
    """
    aggs = [F.count_if(~F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}`" for n in rules)
    return wide.selectExpr(f"stack({len(rules)}, {stack}) as (rule, violations)")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float/double column."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.when(F.isnan(f.name), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# -------------------------------------------------------------------- joins
def batch_lookup(ids: DataFrame, scored: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Requested ids left-joined to scored customers; misses become
    error rows instead of disappearing. Extra columns of ``ids`` (e.g. the
    request ``position``) are kept, so results can be returned in request
    order."""
    j = ids.join(scored, on=id_col, how="left")
    found = F.col("churn_probability").isNotNull()
    return j.withColumn(
        "error", F.when(found, F.lit(None).cast("string")).otherwise(F.lit("customer not found"))
    )


def orphan_rows(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """C4: fact rows whose foreign key has no dimension row (anti join)."""
    return fact.join(dim, fact[fact_key] == dim[dim_key], "left_anti")


def enrich_predictions(pred: DataFrame, cb: DataFrame) -> DataFrame:
    """Risk rows joined back to customer attributes."""
    return pred.join(cb.select("customer_id", "monthly_charges", "tenure_months"), "customer_id", "inner")


def negative_feedback_by_churn(fb: DataFrame, cb: DataFrame) -> DataFrame:
    """Share of negative feedback by churn status of the author."""
    j = fb.select("customer_id", "sentiment_label").join(
        cb.select("customer_id", "churn_status"), "customer_id", "inner")
    return j.groupBy("churn_status").agg(
        F.count(F.lit(1)).alias("n_feedback"),
        rnd(F.avg((F.col("sentiment_label") == "negative").cast("double")) * 100, 6).alias("negative_pct"),
    )


# ------------------------------------------------------------- aggregations
def profile_quality(df: DataFrame, key: str, target: str | None = None) -> DataFrame:
    """Rows, total null cells, duplicate keys, target rate."""
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(nulls).alias("n_null_cells"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("n_duplicate_keys"),
    ]
    if target:
        aggs.append(rnd(F.avg(F.col(target).cast("double")), 6).alias("target_rate"))
    return df.agg(*aggs)


def churn_overview(cb: DataFrame) -> DataFrame:
    """D3."""
    return cb.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("churn_status")).alias("churned"),
        F.count_if(~F.col("churn_status")).alias("retained"),
        rnd(F.avg(F.col("churn_status").cast("double")), 6).alias("churn_rate"),
    )


def segment_counts(cb: DataFrame) -> DataFrame:
    """GROUP BY customer_segment ORDER BY count DESC."""
    seg = with_segments(cb)
    return seg.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), "customer_segment")


def spending_profile(cb: DataFrame) -> DataFrame:
    """Per spending tier, count and mean monthly charge, by mean."""
    seg = with_segments(cb)
    return seg.groupBy("spending_tier").agg(
        F.count(F.lit(1)).alias("count"),
        rnd(F.avg("monthly_charges"), 6).alias("avg_monthly"),
    ).orderBy("avg_monthly")


def tenure_stats(cb: DataFrame) -> DataFrame:
    """D6 (exact median by narrowing intervals)."""
    (median,), = exact_quantiles(cb, [F.col("tenure_months")], [0.5])
    return cb.agg(
        rnd(F.avg("tenure_months"), 6).alias("mean_tenure"),
        F.lit(median).cast("double").alias("median_tenure"),
        F.count_if(F.col("tenure_months") < 12).alias("n_new"),
        F.count_if(F.col("tenure_months") > 36).alias("n_long_term"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and percent of total per value. The total is a scalar
    subquery, so even a high-cardinality column never meets in one task."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return g.withColumn("pct", rnd(F.col("count") * 100.0 / total, 6)).orderBy(F.desc("count"), col)


def demographics(cb: DataFrame) -> DataFrame:
    """Count and share for the five demographic flags, long form."""
    flags = {
        "female": F.col("gender") == "Female",
        "male": F.col("gender") == "Male",
        "senior_citizen": F.col("senior_citizen"),
        "partner": F.col("partner"),
        "dependents": F.col("dependents"),
    }
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(c).alias(k) for k, c in flags.items()]
    wide = cb.agg(*aggs)
    stack = ", ".join(f"'{k}', `{k}`" for k in flags)
    long = wide.selectExpr("_n", f"stack({len(flags)}, {stack}) as (flag, count)")
    return long.select("flag", "count", rnd(F.col("count") / F.col("_n"), 6).alias("share"))


def churn_by(cb: DataFrame, col: str) -> DataFrame:
    """Churn rate per value of ``col``, highest first, with best/worst."""
    g = cb.groupBy(col).agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.avg(F.col("churn_status").cast("double")), 6).alias("churn_rate"),
    )
    # best / worst rate: one struct subquery over the grouped rows (no
    # window that would gather every group into one task)
    ext = g.agg(F.struct(F.max("churn_rate").alias("hi"), F.min("churn_rate").alias("lo"))).scalar()
    return g.withColumn("_e", ext).withColumns({
        "is_highest": F.col("churn_rate") == F.col("_e.hi"),
        "is_lowest": F.col("churn_rate") == F.col("_e.lo"),
    }).drop("_e").orderBy(F.desc("churn_rate"), col)


def churn_by_tenure_band(cb: DataFrame) -> DataFrame:
    """Churn for tenure < 12, > 36 and for TenureGroup 0/1/2."""
    churn = F.col("churn_status").cast("double")
    t = F.col("tenure_months")
    tg = cf.tenure_group(t)
    bands = {
        "tenure_lt_12": t < 12,
        "tenure_gt_36": t > 36,
        "tenure_group_0": tg == 0,
        "tenure_group_1": tg == 1,
        "tenure_group_2": tg == 2,
    }
    aggs = []
    for k, cond in bands.items():
        aggs.append(F.count_if(cond).alias(f"n_{k}"))
        aggs.append(F.avg(F.when(cond, churn)).alias(f"r_{k}"))
    wide = cb.agg(*aggs)
    stack = ", ".join(f"'{k}', `n_{k}`, `r_{k}`" for k in bands)
    long = wide.selectExpr(f"stack({len(bands)}, {stack}) as (band, n, churn_rate)")
    return long.select("band", "n", rnd("churn_rate", 6).alias("churn_rate"))


def revenue_at_risk(cb: DataFrame) -> DataFrame:
    """Monthly revenue of churned customers vs all."""
    return cb.agg(
        rnd(F.sum(F.when(F.col("churn_status"), F.col("monthly_charges")).otherwise(0.0)), 4).alias("churned_revenue"),
        rnd(F.sum("monthly_charges"), 4).alias("total_revenue"),
    ).withColumn("ratio", rnd(F.col("churned_revenue") / F.nullif(F.col("total_revenue"), F.lit(0.0)), 6))


def revenue_at_risk_by_band(scored: DataFrame) -> DataFrame:
    """D11 (model view): monthly revenue in the High Risk analysis band."""
    band = rf.risk_band("churn_probability")
    return scored.agg(
        F.count_if(band == "High Risk").alias("n_high_risk"),
        rnd(F.sum(F.when(band == "High Risk", F.col("monthly_charges")).otherwise(0.0)), 4).alias("revenue_at_risk"),
        rnd(F.sum("monthly_charges"), 4).alias("total_revenue"),
    ).withColumn("pct_at_risk", rnd(F.col("revenue_at_risk") * 100 / F.nullif(F.col("total_revenue"), F.lit(0.0)), 6))


def overview_kpis(cb: DataFrame) -> DataFrame:
    """The dashboard headline row."""
    return cb.agg(
        F.count(F.lit(1)).alias("total_customers"),
        rnd(F.avg(F.col("churn_status").cast("double")) * 100, 6).alias("churn_pct"),
        rnd(F.avg("monthly_charges"), 6).alias("avg_monthly"),
        rnd(F.avg("tenure_months"), 6).alias("avg_tenure"),
        rnd(F.sum(F.when(F.col("churn_status"), F.col("monthly_charges")).otherwise(0.0)), 4).alias("revenue_at_risk"),
    )


def corr_with_target(cb: DataFrame) -> DataFrame:
    """Pearson r of the encoded features with churn, highest first."""
    enc = encode_categoricals(cb)
    aggs = [F.corr(F.col(c).cast("double"), F.col("churn").cast("double")).alias(c) for c in CORR_FEATURES]
    wide = enc.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in CORR_FEATURES)
    long = wide.selectExpr(f"stack({len(CORR_FEATURES)}, {stack}) as (feature, corr)")
    return long.select("feature", rnd("corr", 6).alias("corr")).orderBy(F.desc("corr"), "feature")


def risk_segmentation(scored: DataFrame) -> DataFrame:
    """Per analysis band, count, actual churn, mean p, mean charge."""
    band = rf.risk_band("churn_probability")
    return scored.groupBy(band.alias("risk_band")).agg(
        F.count(F.lit(1)).alias("count"),
        rnd(F.avg(F.col("churn_status").cast("double")), 3).alias("actual_churn_rate"),
        rnd(F.avg("churn_probability"), 3).alias("avg_predicted_prob"),
        rnd(F.avg("monthly_charges"), 3).alias("avg_monthly_charges"),
    )


def _bucket_expr(x, buckets, inclusive: bool):
    expr = None
    for cut, name in buckets:
        if cut is None:
            return expr.otherwise(name)
        cond = (x <= cut) if inclusive else (x < cut)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def histogram_fixed(cb: DataFrame) -> DataFrame:
    """Fixed tenure buckets (total, churned) and charge buckets
    (count), long form (histogram, bucket, total, churned)."""
    t = F.coalesce(F.col("tenure_months"), F.lit(0))
    m = F.coalesce(F.col("monthly_charges"), F.lit(0.0))
    ten = cb.groupBy(F.lit("tenure").alias("histogram"), _bucket_expr(t, TENURE_BUCKETS, True).alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("churn_status")).alias("churned"))
    chg = cb.groupBy(F.lit("monthly_charges").alias("histogram"), _bucket_expr(m, CHARGE_BUCKETS, False).alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("churn_status")).alias("churned"))
    return ten.unionByName(chg)


def histogram_equal_width(df: DataFrame, col: str, n_bins: int = 24, flag: str = "churn_status") -> DataFrame:
    """Equal-width histogram over [min, max]; the max lands in the
    last bin. Global min/max are scalar subqueries (one tiny job)."""
    rng = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))).scalar()
    x = df.filter(F.col(col).isNotNull()).withColumn("_r", rng)
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    v = F.col(col).cast("double")
    # width_bucket semantics, with x == max clamped into the last bin
    wb = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.lit(n_bins), F.floor((v - lo) / ((hi - lo) / F.lit(float(n_bins)))) + 1))
    g = x.groupBy(wb.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("flagged"),
        F.first("_r.lo").alias("_lo"), F.first("_r.hi").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(n_bins))
    return g.select(
        "bin",
        rnd(F.col("_lo") + (F.col("bin") - 1) * width, 6).alias("bin_start"),
        rnd(F.col("_lo") + F.col("bin") * width, 6).alias("bin_end"),
        "total", "flagged",
    )


def batch_summary(looked_up: DataFrame) -> DataFrame:
    """Requested / succeeded / failed / success % over a C2 result."""
    return looked_up.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    ).withColumn("success_pct", rnd(F.col("succeeded") * 100.0 / F.nullif(F.col("requested"), F.lit(0)), 6))


def risk_counts(scored: DataFrame) -> DataFrame:
    """Rows per serving risk level."""
    return scored.groupBy(rf.risk_level("churn_probability").alias("risk_level")).agg(
        F.count(F.lit(1)).alias("count"))


def high_risk_kpis(scored: DataFrame, threshold: float = rf.HIGH_RISK_SCAN_THRESHOLD) -> DataFrame:
    """Count, mean probability and monthly revenue for p >= threshold."""
    hr = F.col("churn_probability") >= threshold
    return scored.agg(
        F.count_if(hr).alias("n_high_risk"),
        rnd(F.avg(F.when(hr, F.col("churn_probability"))), 6).alias("avg_probability"),
        rnd(F.sum(F.when(hr, F.col("monthly_charges")).otherwise(0.0)), 4).alias("revenue_at_risk"),
    )

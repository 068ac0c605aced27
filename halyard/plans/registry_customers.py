"""Registered customer-analytics queries: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.numeric import rnd
from halyard.functions import risk as rf
from halyard.operators import customers as cu
from halyard.plans import adapters as ad
from halyard.plans.materialize import customer_dimension, daily_demand_fact
from halyard.sources.io import read_table

LOOKUP_ID = 10


def a02_read_table(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer")


def b01_clean_customers(spark, d):
    return cu.clean_customers(ad.customer_base_raw(spark, d, customer_dimension(spark, d)))


def b02_coerce_numeric(spark, d):
    return cu.coerce_numeric(ad.customer_base_raw(spark, d, customer_dimension(spark, d)))


def b03_coerce_or_zero(spark, d):
    return cu.coerce_or_zero(ad.customer_base_raw(spark, d, customer_dimension(spark, d)))


def b04_customer_segment(spark, d):
    return cu.with_segments(customer_dimension(spark, d)).select("customer_id", "customer_segment")


def b05_spending_tier(spark, d):
    return cu.with_segments(customer_dimension(spark, d)).select("customer_id", "spending_tier")


def b06_demand_driver(spark, d):
    from halyard.functions.customer import demand_driver

    dd = daily_demand_fact(spark, d)
    return dd.select("series_id", "ds", demand_driver("is_holiday", "is_promo", "is_weekend").alias("demand_driver"))


def b07_encode_categoricals(spark, d):
    return cu.encode_categoricals(customer_dimension(spark, d))


def _features(spark, d):
    return cu.engineer_features(customer_dimension(spark, d))


def b08_avg_charges_per_month(spark, d):
    return _features(spark, d).select("customer_id", rnd("avg_charges_per_month", 6).alias("avg_charges_per_month"))


def b09_tenure_group(spark, d):
    return _features(spark, d).select("customer_id", "tenure_months", "tenure_group")


def b10_tenure_group_detailed(spark, d):
    return _features(spark, d).select("customer_id", "tenure_months", "tenure_group_detailed")


def b11_is_high_value(spark, d):
    return _features(spark, d).select("customer_id", "monthly_charges", "is_high_value")


def b12_revenue_category(spark, d):
    return _features(spark, d).select("customer_id", "monthly_charges", "revenue_category")


def b13_senior_with_family(spark, d):
    return _features(spark, d).select("customer_id", "senior_with_family")


def b14_interactions(spark, d):
    return _features(spark, d).select(
        "customer_id", "contract_tenure_interaction",
        rnd("charges_tenure_ratio", 6).alias("charges_tenure_ratio"),
        rnd("customer_value_proxy", 6).alias("customer_value_proxy"))


MODEL_FEATURES = ["gender", "senior_citizen", "partner", "dependents", "tenure_months", "contract",
                  "payment_method", "monthly_charges", "total_charges", "avg_charges_per_month",
                  "tenure_group", "is_high_value", "phone_service"]


def b15_align_features(spark, d):
    # 'phone_service' is not in the frame: aligned as 0 like any missing column
    out = cu.align_features(_features(spark, d), MODEL_FEATURES)
    return out.withColumn("avg_charges_per_month", rnd("avg_charges_per_month", 6))


def _scored(spark, d):
    return ad.scored_customers(spark, d, customer_dimension(spark, d))


def b16_risk_level(spark, d):
    return _scored(spark, d).select("customer_id", "churn_probability", rf.risk_level("churn_probability").alias("risk_level"))


def b17_risk_band(spark, d):
    return _scored(spark, d).select("customer_id", "churn_probability", rf.risk_band("churn_probability").alias("risk_band"))


def b18_recommendations(spark, d):
    return _scored(spark, d).select("customer_id", rf.recommendations("churn_probability").alias("recommendations"))


def b19_classify(spark, d):
    return _scored(spark, d).select("customer_id", rf.classify("churn_probability", 0.5).alias("churn_prediction"))


def b20_lookup_customer(spark, d):
    return cu.lookup_customer(customer_dimension(spark, d), LOOKUP_ID)


def b21_validate_constraints(spark, d):
    orders = read_table(spark, d, "orders")
    o_rules = {
        "orders_custkey_not_null": F.col("o_custkey").isNotNull(),
        "orders_date_not_null": F.col("o_orderdate").isNotNull(),
        "orders_amount_positive": F.col("o_totalprice") > 0,
    }
    dd = daily_demand_fact(spark, d)
    d_rules = {
        "demand_discount_in_0_1": F.col("discount_pct").between(0, 1),
        "demand_dow_in_0_6": F.col("day_of_week").between(0, 6),
        "demand_woy_in_1_53": F.col("week_of_year").between(1, 53),
        "demand_month_in_1_12": F.col("month").between(1, 12),
        "demand_orders_not_null": F.col("y").isNotNull(),
    }
    fb = ad.feedback(spark, d)
    f_rules = {"feedback_score_in_range": F.col("sentiment_score").between(-1, 1)}
    return (cu.validate_constraints(orders, o_rules)
            .unionByName(cu.validate_constraints(dd, d_rules))
            .unionByName(cu.validate_constraints(fb, f_rules)))


def b22_nan_to_null(spark, d):
    return cu.nan_to_null(read_table(spark, d, "events"))


def c02_batch_lookup(spark, d):
    ids = read_table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"))
    out = cu.batch_lookup(ids, _scored(spark, d))
    found = F.col("churn_probability").isNotNull()
    return out.select("customer_id", "churn_probability",
                      F.when(found, rf.risk_level("churn_probability")).alias("risk_level"), "error")


def c04_orphan_check(spark, d):
    orders = read_table(spark, d, "orders")
    cust = read_table(spark, d, "customer")
    li = read_table(spark, d, "lineitem")
    o = cu.orphan_rows(orders, cust, "o_custkey", "c_custkey").select(
        F.lit("orders.o_custkey").alias("fk"), F.col("o_orderkey").alias("row_key"))
    li_o = cu.orphan_rows(li, orders, "l_orderkey", "o_orderkey").select(
        F.lit("lineitem.l_orderkey").alias("fk"), F.col("l_orderkey").alias("row_key"))
    fb = ad.feedback(spark, d)
    f = cu.orphan_rows(fb, customer_dimension(spark, d), "customer_id", "customer_id").select(
        F.lit("feedback.customer_id").alias("fk"), F.col("feedback_id").alias("row_key"))
    return o.unionByName(li_o).unionByName(f)


def c06_enrich_predictions(spark, d):
    sc = _scored(spark, d)
    pred = sc.select("customer_id", "churn_probability", rf.risk_level("churn_probability").alias("risk_level"))
    return cu.enrich_predictions(pred, customer_dimension(spark, d))


def c07_feedback_by_churn(spark, d):
    return cu.negative_feedback_by_churn(ad.feedback(spark, d), customer_dimension(spark, d))


def d01_profile_quality(spark, d):
    return cu.profile_quality(cu.clean_customers(ad.customer_base_raw(spark, d, customer_dimension(spark, d))), "customer_id", "churn_status")


def d02_load_summary(spark, d):
    dd = daily_demand_fact(spark, d, "all")
    return dd.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("ds").alias("first_day"),
        F.max("ds").alias("last_day"),
        rnd(F.avg("y"), 6).alias("avg_orders"),
        rnd(F.avg("revenue"), 4).alias("avg_revenue"),
    )


def d03_churn_overview(spark, d):
    return cu.churn_overview(customer_dimension(spark, d))


def d04_segment_counts(spark, d):
    return cu.segment_counts(customer_dimension(spark, d))


def d05_spending_profile(spark, d):
    return cu.spending_profile(customer_dimension(spark, d))


def d06_tenure_stats(spark, d):
    return cu.tenure_stats(customer_dimension(spark, d))


def d07_value_counts(spark, d):
    return cu.value_counts(customer_dimension(spark, d), "subscription_type")


def d08_demographics(spark, d):
    return cu.demographics(customer_dimension(spark, d))


def d09_churn_by_contract(spark, d):
    return cu.churn_by(customer_dimension(spark, d), "subscription_type")


def d10_churn_by_tenure_band(spark, d):
    return cu.churn_by_tenure_band(customer_dimension(spark, d))


def d11_revenue_at_risk(spark, d):
    return cu.revenue_at_risk(customer_dimension(spark, d))


def d11b_revenue_at_risk_by_band(spark, d):
    return cu.revenue_at_risk_by_band(_scored(spark, d))


def d12_overview_kpis(spark, d):
    return cu.overview_kpis(customer_dimension(spark, d))


def d13_corr_with_target(spark, d):
    return cu.corr_with_target(customer_dimension(spark, d))


def d14_risk_segmentation(spark, d):
    return cu.risk_segmentation(_scored(spark, d))


def d15_histogram_fixed(spark, d):
    return cu.histogram_fixed(customer_dimension(spark, d))


def d16_histogram_equal_width(spark, d):
    return cu.histogram_equal_width(customer_dimension(spark, d), "tenure_months", 24)


def d17_batch_summary(spark, d):
    ids = read_table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"))
    return cu.batch_summary(cu.batch_lookup(ids, _scored(spark, d)))


def d18_risk_counts(spark, d):
    return cu.risk_counts(_scored(spark, d))


def d19_high_risk_kpis(spark, d):
    return cu.high_risk_kpis(_scored(spark, d))


QUERIES = {name: fn for name, fn in list(globals().items())
           if callable(fn) and name[:1] in "abcd" and name[1:3].isdigit()}

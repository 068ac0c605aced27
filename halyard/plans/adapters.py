"""Adapter views binding the star-schema test tables to the data model of
customer analytics: customer base (CB), raw customer export (CB raw), daily
demand series (DD), feedback (FB) and event sentiment.

All views are lazy DataFrames; Catalyst prunes the columns each consumer
uses and pushes filters into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.numeric import rnd
from halyard.functions import calendar as cal
from halyard.functions import text as tx
from halyard.sources.io import read_table

# ---------------------------------------------------------------------------
# Fixed values of the adapter mapping (test-data binding, not business rules).
SEGMENT_TO_CONTRACT = {
    "AUTOMOBILE": "Month-to-month", "BUILDING": "Month-to-month",
    "FURNITURE": "One year", "HOUSEHOLD": "One year",
    "MACHINERY": "Two year",
}
CHARGE_SCALE = 3500.0
CHURN_RECENCY_DAYS = 365
FEEDBACK_EPOCH = "2023-01-01"
FEEDBACK_SPAN_DAYS = 730
# ---------------------------------------------------------------------------


def _contract_from_segment(seg):
    expr = None
    for k, v in SEGMENT_TO_CONTRACT.items():
        expr = F.when(seg == k, v) if expr is None else expr.when(seg == k, v)
    return expr


def _order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer order count, spend and last order date (one shuffle)."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("ck")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("tot"),
        F.max("o_orderdate").alias("last_dt"),
    )


def customer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CB: one row per customer with at least one order."""
    roll = _order_rollup(spark, sf_dir)
    gmax = read_table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()
    cust = read_table(spark, sf_dir, "customer")
    j = cust.join(roll, cust.c_custkey == roll.ck, "inner")
    return j.select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        (F.col("c_acctbal") < 0).alias("senior_citizen"),
        (F.col("c_nationkey") % 5 < 2).alias("partner"),
        (F.col("c_custkey") % 10 < 3).alias("dependents"),
        (F.lit(4) * (F.col("n_orders") - 1)).cast("int").alias("tenure_months"),
        _contract_from_segment(F.col("c_mktsegment")).alias("subscription_type"),
        F.when(F.col("c_custkey") % 4 == 0, "Electronic check").otherwise("Credit card").alias("payment_method"),
        rnd(F.col("tot") / F.col("n_orders") / CHARGE_SCALE, 2).alias("monthly_charges"),
        rnd(F.col("tot") / CHARGE_SCALE, 2).alias("total_charges"),
        (F.datediff(F.to_date(gmax), F.to_date("last_dt")) > CHURN_RECENCY_DAYS).alias("churn_status"),
    )


def customer_base_raw(spark: SparkSession, sf_dir: str, cb: DataFrame | None = None) -> DataFrame:
    """CB raw: the same customers as an all-text export with source names."""
    cb = customer_base(spark, sf_dir) if cb is None else cb
    yn = lambda c: F.when(c, "Yes").otherwise("No")
    return cb.select(
        F.col("customer_id").cast("string").alias("customerID"),
        F.col("gender"),
        F.col("senior_citizen").cast("int").cast("string").alias("SeniorCitizen"),
        yn(F.col("partner")).alias("Partner"),
        yn(F.col("dependents")).alias("Dependents"),
        F.col("tenure_months").cast("string").alias("tenure"),
        F.col("subscription_type").alias("Contract"),
        F.col("payment_method").alias("PaymentMethod"),
        F.col("monthly_charges").cast("string").alias("MonthlyCharges"),
        F.when(F.col("tenure_months") == 0, F.lit(" "))
        .otherwise(F.col("total_charges").cast("string")).alias("TotalCharges"),
        yn(F.col("churn_status")).alias("Churn"),
    )


def proxy_probability(customer_id) -> F.Column:
    """Deterministic stand-in churn probability in [0, 1)."""
    return ((customer_id * F.lit(7919)) % F.lit(1000)) / F.lit(1000.0)


def scored_customers(spark: SparkSession, sf_dir: str, cb: DataFrame | None = None) -> DataFrame:
    """CB plus the proxy probability as ``churn_probability``."""
    cb = customer_base(spark, sf_dir) if cb is None else cb
    return cb.withColumn("churn_probability", proxy_probability(F.col("customer_id")))


def daily_demand(spark: SparkSession, sf_dir: str, series: str = "segment") -> DataFrame:
    """DD: (series_id, ds) daily demand with calendar and event flags.

    ``series``: 'segment' (market segment), 'nation' or 'all'. Lineitems are
    pre-aggregated per order before the join so the big side shuffles once
    and the join reuses that partitioning.
    """
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_discount").alias("sd"),
        F.count(F.lit(1)).alias("nl"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("spend"),
    )
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    o = orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
    if series == "all":
        keyed = o.withColumn("series_id", F.lit("all"))
    else:
        cust = read_table(spark, sf_dir, "customer")
        col = "c_mktsegment" if series == "segment" else "c_nationkey"
        cust = cust.select("c_custkey", F.col(col).cast("string").alias("series_id"))
        keyed = o.join(cust, o.o_custkey == cust.c_custkey, "inner")
    dd = keyed.groupBy("series_id", F.to_date("o_orderdate").alias("ds")).agg(
        F.count(F.lit(1)).cast("double").alias("y"),
        F.sum("o_totalprice").alias("revenue_raw"),
        F.sum("sd").alias("sd"),
        F.sum("nl").alias("nl"),
        F.sum("spend").alias("spend"),
    )
    return dd.select(
        "series_id", "ds", "y",
        rnd("revenue_raw", 2).alias("revenue"),
        rnd(F.col("revenue_raw") / F.col("y"), 6).alias("avg_order_value"),
        rnd(F.coalesce(F.col("sd") / F.col("nl"), F.lit(0.0)), 6).alias("discount_pct"),
        rnd(F.coalesce(F.col("spend"), F.lit(0.0)), 2).alias("marketing_spend"),
        cal.day_of_week("ds").alias("day_of_week"),
        F.weekofyear("ds").alias("week_of_year"),
        F.month("ds").alias("month"),
        cal.is_weekend("ds").alias("is_weekend"),
        cal.is_holiday("ds").alias("is_holiday"),
        cal.is_promo("ds").alias("is_promo"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB: documents seen as customer feedback."""
    docs = read_table(spark, sf_dir, "documents")
    n_cust = read_table(spark, sf_dir, "customer").agg(F.count(F.lit(1))).scalar()
    score = ((F.col("doc_id") * 31) % 201 - 100) / F.lit(100.0)
    return docs.select(
        F.col("doc_id").alias("feedback_id"),
        (F.col("doc_id") % n_cust).alias("customer_id"),
        F.col("text").alias("feedback_text"),
        F.col("lang").alias("category"),
        F.col("source").alias("channel"),
        F.timestamp_add("DAY", (F.col("doc_id") * 37) % FEEDBACK_SPAN_DAYS,
                        F.lit(FEEDBACK_EPOCH).cast("timestamp_ntz")).alias("created_at"),
        score.alias("sentiment_score"),
        tx.sentiment_from_score(score).alias("sentiment_label"),
    )


def event_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sentiment stream: compound in [-1, 1] and its label."""
    ev = read_table(spark, sf_dir, "events")
    mag = F.least(F.col("value") / 100.0, F.lit(1.0))
    compound = (
        F.when(F.col("event_type") == "error", -mag)
        .when(F.col("event_type").isin("purchase", "signup"), mag)
        .otherwise(F.lit(0.0))
    )
    lab = tx.label_from_compound(compound)
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        compound.alias("sentiment_score"),
        lab.getField("label").alias("sentiment_label"),
        lab.getField("score").alias("label_score"),
    )

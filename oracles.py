"""DuckDB SQL oracles for the registered Spark queries.

Each adapter view of ``halyard.plans.adapters`` is restated once here as a
SQL CTE; each oracle composes those CTEs with plain ANSI SQL. Column names
and rounding equal the Spark side so results compare value by value.
"""

from __future__ import annotations

from halyard.functions import calendar as cal
from halyard.functions import risk as rf
from halyard.functions import text as tx


def _sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


CB = """
ord_roll AS (
  SELECT o_custkey AS ck, count(*) AS n_orders, sum(o_totalprice) AS tot, max(o_orderdate) AS last_dt
  FROM orders GROUP BY o_custkey
),
cb AS (
  SELECT c.c_custkey AS customer_id,
    CASE WHEN c.c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    c.c_acctbal < 0 AS senior_citizen,
    c.c_nationkey % 5 < 2 AS partner,
    c.c_custkey % 10 < 3 AS dependents,
    CAST(4 * (r.n_orders - 1) AS INTEGER) AS tenure_months,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Month-to-month' WHEN 'BUILDING' THEN 'Month-to-month'
      WHEN 'FURNITURE' THEN 'One year' WHEN 'HOUSEHOLD' THEN 'One year'
      WHEN 'MACHINERY' THEN 'Two year' END AS subscription_type,
    CASE WHEN c.c_custkey % 4 = 0 THEN 'Electronic check' ELSE 'Credit card' END AS payment_method,
    round(r.tot / r.n_orders / 3500.0, 2) AS monthly_charges,
    round(r.tot / 3500.0, 2) AS total_charges,
    (CAST((SELECT max(o_orderdate) FROM orders) AS DATE) - CAST(r.last_dt AS DATE)) > 365 AS churn_status
  FROM customer c JOIN ord_roll r ON c.c_custkey = r.ck
)"""

SCORED = CB + """,
scored AS (
  SELECT *, CAST(customer_id * 7919 % 1000 AS DOUBLE) / 1000.0 AS churn_probability FROM cb
)"""

CB_RAW = CB + """,
cb_raw AS (
  SELECT CAST(customer_id AS VARCHAR) AS customerID, gender,
    CAST(CAST(senior_citizen AS INTEGER) AS VARCHAR) AS SeniorCitizen,
    CASE WHEN partner THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN dependents THEN 'Yes' ELSE 'No' END AS Dependents,
    CAST(tenure_months AS VARCHAR) AS tenure,
    subscription_type AS Contract, payment_method AS PaymentMethod,
    CAST(monthly_charges AS VARCHAR) AS MonthlyCharges,
    CASE WHEN tenure_months = 0 THEN ' ' ELSE CAST(total_charges AS VARCHAR) END AS TotalCharges,
    CASE WHEN churn_status THEN 'Yes' ELSE 'No' END AS Churn
  FROM cb
)"""


def _dd(series: str = "segment") -> str:
    if series == "all":
        key, join = "'all'", ""
    else:
        col = "c.c_mktsegment" if series == "segment" else "CAST(c.c_nationkey AS VARCHAR)"
        key, join = col, "JOIN customer c ON o.o_custkey = c.c_custkey"
    hol = _sql_list(cal.HOLIDAY_MONTH_DAYS)
    promo = _sql_list(cal.PROMO_MONTH_DAYS)
    return f"""
li_roll AS (
  SELECT l_orderkey, sum(l_discount) AS sd, count(*) AS nl, sum(l_extendedprice * l_discount) AS spend
  FROM lineitem GROUP BY l_orderkey
),
dd_raw AS (
  SELECT {key} AS series_id, CAST(o.o_orderdate AS DATE) AS ds,
    CAST(count(*) AS DOUBLE) AS y, sum(o.o_totalprice) AS revenue_raw,
    sum(li.sd) AS sd, sum(li.nl) AS nl, sum(li.spend) AS spend
  FROM orders o LEFT JOIN li_roll li ON o.o_orderkey = li.l_orderkey {join}
  GROUP BY 1, 2
),
dd AS (
  SELECT series_id, ds, y,
    round(revenue_raw, 2) AS revenue,
    round(revenue_raw / y, 6) AS avg_order_value,
    round(coalesce(sd / nl, 0.0), 6) AS discount_pct,
    round(coalesce(spend, 0.0), 2) AS marketing_spend,
    CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week,
    CAST(weekofyear(ds) AS INTEGER) AS week_of_year,
    CAST(month(ds) AS INTEGER) AS month,
    isodow(ds) >= 6 AS is_weekend,
    strftime(ds, '%m-%d') IN ({hol}) AS is_holiday,
    strftime(ds, '%m-%d') IN ({promo}) AS is_promo
  FROM dd_raw
)"""


DD = _dd("segment")
DD_ALL = _dd("all")

FB = """
fb AS (
  SELECT doc_id AS feedback_id,
    doc_id % (SELECT count(*) FROM customer) AS customer_id,
    text AS feedback_text, lang AS category, source AS channel,
    TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST((doc_id * 37) % 730 AS INTEGER)) AS created_at,
    CAST((doc_id * 31) % 201 - 100 AS DOUBLE) / 100.0 AS sentiment_score,
    CASE WHEN CAST((doc_id * 31) % 201 - 100 AS DOUBLE) / 100.0 > 0.2 THEN 'positive'
         WHEN CAST((doc_id * 31) % 201 - 100 AS DOUBLE) / 100.0 < -0.2 THEN 'negative'
         ELSE 'neutral' END AS sentiment_label
  FROM documents
)"""

EV = """
ev0 AS (
  SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_type = 'error' THEN -least(value / 100.0, 1.0)
         WHEN event_type IN ('purchase', 'signup') THEN least(value / 100.0, 1.0)
         ELSE 0.0 END AS sentiment_score
  FROM events
),
ev AS (
  SELECT *,
    CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative'
         ELSE 'neutral' END AS sentiment_label,
    round(CASE WHEN sentiment_score >= 0.05 THEN (sentiment_score + 1) / 2
         WHEN sentiment_score <= -0.05 THEN (1 - sentiment_score) / 2 ELSE 0.5 END, 4) AS label_score
  FROM ev0
)"""


def segment_sql(churn="churn_status", tenure="tenure_months", monthly="monthly_charges") -> str:
    return (f"CASE WHEN {churn} THEN 'Churned' WHEN {tenure} >= 36 THEN 'Long-term' "
            f"WHEN {monthly} > 70 THEN 'High-value' WHEN {tenure} < 12 THEN 'New' ELSE 'Regular' END")


def tier_sql(monthly="monthly_charges") -> str:
    return f"CASE WHEN {monthly} < 35 THEN 'Low' WHEN {monthly} < 65 THEN 'Medium' ELSE 'High' END"


def risk_level_sql(p="churn_probability") -> str:
    return f"CASE WHEN {p} >= 0.7 THEN 'High Risk' WHEN {p} >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END"


def risk_band_sql(p="churn_probability") -> str:
    return (f"CASE WHEN {p} > 0.0 AND {p} <= 0.3 THEN 'Low Risk' WHEN {p} > 0.3 AND {p} <= 0.7 THEN 'Medium Risk' "
            f"WHEN {p} > 0.7 AND {p} <= 1.0 THEN 'High Risk' END")


def recommendations_sql(p="churn_probability") -> str:
    parts = []
    default = None
    for cut, items in rf.RECOMMENDATIONS:
        arr = "[" + _sql_list(items) + "]"
        if cut is None:
            default = arr
        else:
            parts.append(f"WHEN {p} >= {cut} THEN {arr}")
    return "CASE " + " ".join(parts) + f" ELSE {default} END"


def tenure_group_sql(t="tenure_months") -> str:
    return f"CASE WHEN {t} <= 12 THEN 0 WHEN {t} <= 36 THEN 1 ELSE 2 END"


def tenure_group_detailed_sql(t="tenure_months") -> str:
    return (f"CASE WHEN {t} > 0 AND {t} <= 6 THEN 0 WHEN {t} > 6 AND {t} <= 12 THEN 1 "
            f"WHEN {t} > 12 AND {t} <= 24 THEN 2 WHEN {t} > 24 AND {t} <= 36 THEN 3 "
            f"WHEN {t} > 36 AND {t} <= 100 THEN 4 ELSE -1 END")


def encoded_sql(src="cb") -> str:
    return f"""
SELECT customer_id,
  CASE WHEN gender = 'Male' THEN 1 ELSE 0 END AS gender,
  coalesce(CAST(senior_citizen AS INTEGER), 0) AS senior_citizen,
  coalesce(CAST(partner AS INTEGER), 0) AS partner,
  coalesce(CAST(dependents AS INTEGER), 0) AS dependents,
  tenure_months,
  CASE WHEN subscription_type = 'Two year' THEN 2 WHEN subscription_type = 'One year' THEN 1 ELSE 0 END AS contract,
  CASE WHEN payment_method = 'Electronic check' THEN 0 ELSE 1 END AS payment_method,
  monthly_charges, total_charges,
  coalesce(CAST(churn_status AS INTEGER), 0) AS churn
FROM {src}"""


def lexicon_array_sql(words) -> str:
    return "[" + _sql_list(words) + "]"


def stop_words_sql() -> str:
    return "[" + _sql_list(tx.english_stop_words()) + "]"


def _w(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip().rstrip(",") + "\n" + body


_RAW_NUM = {
    "tenure": "TRY_CAST(trim(tenure) AS DOUBLE)",
    "monthly": "TRY_CAST(trim(MonthlyCharges) AS DOUBLE)",
    "total": "TRY_CAST(trim(TotalCharges) AS DOUBLE)",
}

_FEATURES = f"""
feat AS (
  SELECT e.*,
    e.total_charges / (e.tenure_months + 1) AS avg_charges_per_month,
    {tenure_group_sql('e.tenure_months')} AS tenure_group,
    {tenure_group_detailed_sql('e.tenure_months')} AS tenure_group_detailed,
    CAST(e.monthly_charges > (SELECT quantile_cont(monthly_charges, 0.5) FROM cb) AS INTEGER) AS is_high_value,
    CASE WHEN s.hi = s.lo THEN 1 ELSE least(2, greatest(0,
      CAST(ceil((e.monthly_charges - s.lo) / ((s.hi - s.lo) / 3.0)) - 1 AS INTEGER))) END AS revenue_category,
    CAST(e.senior_citizen = 1 AND (e.partner = 1 OR e.dependents = 1) AS INTEGER) AS senior_with_family,
    e.contract * e.tenure_months AS contract_tenure_interaction,
    e.monthly_charges / (e.tenure_months + 1) AS charges_tenure_ratio,
    e.tenure_months * e.monthly_charges / 100.0 AS customer_value_proxy
  FROM enc e CROSS JOIN (SELECT min(monthly_charges) AS lo, max(monthly_charges) AS hi FROM cb) s
)"""

_FEAT_CTES = CB + ",\nenc AS (" + encoded_sql("cb") + "\n)," + _FEATURES


def _clean_sql(src="cb_raw") -> str:
    return f"""
SELECT customerID AS customer_id, gender,
  CASE WHEN TRY_CAST(trim(SeniorCitizen) AS INTEGER) IS NULL THEN NULL
       ELSE TRY_CAST(trim(SeniorCitizen) AS INTEGER) <> 0 END AS senior_citizen,
  CASE WHEN Partner = 'Yes' THEN true WHEN Partner = 'No' THEN false END AS partner,
  CASE WHEN Dependents = 'Yes' THEN true WHEN Dependents = 'No' THEN false END AS dependents,
  TRY_CAST(trim(tenure) AS INTEGER) AS tenure_months,
  Contract AS subscription_type, PaymentMethod AS payment_method,
  {_RAW_NUM['monthly']} AS monthly_charges,
  coalesce({_RAW_NUM['total']}, {_RAW_NUM['monthly']} * TRY_CAST(trim(tenure) AS INTEGER)) AS total_charges,
  CASE WHEN Churn = 'Yes' THEN true WHEN Churn = 'No' THEN false END AS churn_status
FROM {src}"""


def _stack_counts(rows) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS rule, CAST(count(*) FILTER (WHERE NOT coalesce({cond}, false)) AS BIGINT) AS violations FROM {src}"
        for name, cond, src in rows)


CUSTOMER_SQL = {
    "a01_read_customers_csv": _w(CB_RAW, "SELECT * FROM cb_raw"),
    "a02_read_table": "SELECT * FROM customer",
    "a03_overwrite_table": _w(CB_RAW, "SELECT * REPLACE (CAST(customer_id AS BIGINT) AS customer_id) FROM (" + _clean_sql() + ")"),
    "a04_write_csv": _w(SCORED, f"SELECT customer_id, churn_probability, {risk_level_sql()} AS risk_level FROM scored"),
    "b01_clean_customers": _w(CB_RAW, _clean_sql()),
    "b02_coerce_numeric": _w(CB_RAW, f"""
SELECT customerID, {_RAW_NUM['tenure']} AS tenure, {_RAW_NUM['monthly']} AS monthly_charges,
  {_RAW_NUM['total']} AS total_charges_parsed,
  coalesce({_RAW_NUM['total']}, {_RAW_NUM['monthly']} * {_RAW_NUM['tenure']}) AS total_charges
FROM cb_raw"""),
    "b03_coerce_or_zero": _w(CB_RAW, f"""
SELECT customerID, coalesce({_RAW_NUM['tenure']}, 0.0) AS tenure,
  coalesce({_RAW_NUM['monthly']}, 0.0) AS monthly_charges, coalesce({_RAW_NUM['total']}, 0.0) AS total_charges
FROM cb_raw"""),
    "b04_customer_segment": _w(CB, f"SELECT customer_id, {segment_sql()} AS customer_segment FROM cb"),
    "b05_spending_tier": _w(CB, f"SELECT customer_id, {tier_sql()} AS spending_tier FROM cb"),
    "b06_demand_driver": _w(DD, """
SELECT series_id, ds, CASE WHEN is_holiday THEN 'Holiday' WHEN is_promo THEN 'Promotion'
  WHEN is_weekend THEN 'Weekend' ELSE 'Standard' END AS demand_driver FROM dd"""),
    "b07_encode_categoricals": _w(CB, encoded_sql("cb")),
    "b08_avg_charges_per_month": _w(_FEAT_CTES, "SELECT customer_id, round(avg_charges_per_month, 6) AS avg_charges_per_month FROM feat"),
    "b09_tenure_group": _w(_FEAT_CTES, "SELECT customer_id, tenure_months, tenure_group FROM feat"),
    "b10_tenure_group_detailed": _w(_FEAT_CTES, "SELECT customer_id, tenure_months, tenure_group_detailed FROM feat"),
    "b11_is_high_value": _w(_FEAT_CTES, "SELECT customer_id, monthly_charges, is_high_value FROM feat"),
    "b12_revenue_category": _w(_FEAT_CTES, "SELECT customer_id, monthly_charges, revenue_category FROM feat"),
    "b13_senior_with_family": _w(_FEAT_CTES, "SELECT customer_id, senior_with_family FROM feat"),
    "b14_interactions": _w(_FEAT_CTES, """
SELECT customer_id, contract_tenure_interaction, round(charges_tenure_ratio, 6) AS charges_tenure_ratio,
  round(customer_value_proxy, 6) AS customer_value_proxy FROM feat"""),
    "b15_align_features": _w(_FEAT_CTES, """
SELECT customer_id, CAST(gender AS DOUBLE) AS gender, CAST(senior_citizen AS DOUBLE) AS senior_citizen,
  CAST(partner AS DOUBLE) AS partner, CAST(dependents AS DOUBLE) AS dependents,
  CAST(tenure_months AS DOUBLE) AS tenure_months, CAST(contract AS DOUBLE) AS contract,
  CAST(payment_method AS DOUBLE) AS payment_method, monthly_charges, total_charges,
  round(avg_charges_per_month, 6) AS avg_charges_per_month, CAST(tenure_group AS DOUBLE) AS tenure_group,
  CAST(is_high_value AS DOUBLE) AS is_high_value, CAST(0 AS DOUBLE) AS phone_service
FROM feat"""),
    "b16_risk_level": _w(SCORED, f"SELECT customer_id, churn_probability, {risk_level_sql()} AS risk_level FROM scored"),
    "b17_risk_band": _w(SCORED, f"SELECT customer_id, churn_probability, {risk_band_sql()} AS risk_band FROM scored"),
    "b18_recommendations": _w(SCORED, f"SELECT customer_id, {recommendations_sql()} AS recommendations FROM scored"),
    "b19_classify": _w(SCORED, "SELECT customer_id, churn_probability >= 0.5 AS churn_prediction FROM scored"),
    "b20_lookup_customer": _w(CB, "SELECT * FROM cb WHERE customer_id = 10"),
    "b21_validate_constraints": _w(DD + "," + FB, _stack_counts([
        ("orders_custkey_not_null", "o_custkey IS NOT NULL", "orders"),
        ("orders_date_not_null", "o_orderdate IS NOT NULL", "orders"),
        ("orders_amount_positive", "o_totalprice > 0", "orders"),
        ("demand_discount_in_0_1", "discount_pct BETWEEN 0 AND 1", "dd"),
        ("demand_dow_in_0_6", "day_of_week BETWEEN 0 AND 6", "dd"),
        ("demand_woy_in_1_53", "week_of_year BETWEEN 1 AND 53", "dd"),
        ("demand_month_in_1_12", "month BETWEEN 1 AND 12", "dd"),
        ("demand_orders_not_null", "y IS NOT NULL", "dd"),
        ("feedback_score_in_range", "sentiment_score BETWEEN -1 AND 1", "fb"),
    ])),
    "b22_nan_to_null": """
SELECT event_id, ts, user_id, event_type, CASE WHEN isnan(value) THEN NULL ELSE value END AS value, props
FROM events""",
    "c02_batch_lookup": _w(SCORED, f"""
SELECT c.c_custkey AS customer_id, s.churn_probability,
  CASE WHEN s.churn_probability IS NOT NULL THEN {risk_level_sql('s.churn_probability')} END AS risk_level,
  CASE WHEN s.churn_probability IS NULL THEN 'customer not found' END AS error
FROM customer c LEFT JOIN scored s ON c.c_custkey = s.customer_id"""),
    "c04_orphan_check": _w(CB + "," + FB, """
SELECT 'orders.o_custkey' AS fk, o_orderkey AS row_key FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL
SELECT 'lineitem.l_orderkey' AS fk, l_orderkey AS row_key FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL
SELECT 'feedback.customer_id' AS fk, feedback_id AS row_key FROM fb f
  WHERE NOT EXISTS (SELECT 1 FROM cb WHERE cb.customer_id = f.customer_id)"""),
    "c06_enrich_predictions": _w(SCORED, f"""
SELECT s.customer_id, s.churn_probability, {risk_level_sql('s.churn_probability')} AS risk_level,
  c.monthly_charges, c.tenure_months
FROM scored s JOIN cb c ON s.customer_id = c.customer_id"""),
    "c07_feedback_by_churn": _w(CB + "," + FB, """
SELECT c.churn_status, count(*) AS n_feedback,
  round(avg(CAST(f.sentiment_label = 'negative' AS DOUBLE)) * 100, 6) AS negative_pct
FROM fb f JOIN cb c ON f.customer_id = c.customer_id GROUP BY c.churn_status"""),
    "d01_profile_quality": _w(CB_RAW + ",\nclean AS (" + _clean_sql() + "\n)", """
SELECT count(*) AS n_rows,
  CAST(sum(CAST(customer_id IS NULL AS BIGINT) + CAST(gender IS NULL AS BIGINT) + CAST(senior_citizen IS NULL AS BIGINT)
    + CAST(partner IS NULL AS BIGINT) + CAST(dependents IS NULL AS BIGINT) + CAST(tenure_months IS NULL AS BIGINT)
    + CAST(subscription_type IS NULL AS BIGINT) + CAST(payment_method IS NULL AS BIGINT)
    + CAST(monthly_charges IS NULL AS BIGINT) + CAST(total_charges IS NULL AS BIGINT)
    + CAST(churn_status IS NULL AS BIGINT)) AS BIGINT) AS n_null_cells,
  count(*) - count(DISTINCT customer_id) AS n_duplicate_keys,
  round(avg(CAST(churn_status AS DOUBLE)), 6) AS target_rate
FROM clean"""),
    "d02_load_summary": _w(DD_ALL, """
SELECT count(*) AS n_days, min(ds) AS first_day, max(ds) AS last_day,
  round(avg(y), 6) AS avg_orders, round(avg(revenue), 4) AS avg_revenue FROM dd"""),
    "d03_churn_overview": _w(CB, """
SELECT count(*) AS total, count(*) FILTER (WHERE churn_status) AS churned,
  count(*) FILTER (WHERE NOT churn_status) AS retained,
  round(avg(CAST(churn_status AS DOUBLE)), 6) AS churn_rate FROM cb"""),
    "d04_segment_counts": _w(CB, f"""
SELECT {segment_sql()} AS customer_segment, count(*) AS count FROM cb GROUP BY 1 ORDER BY count DESC, 1"""),
    "d05_spending_profile": _w(CB, f"""
SELECT {tier_sql()} AS spending_tier, count(*) AS count, round(avg(monthly_charges), 6) AS avg_monthly
FROM cb GROUP BY 1 ORDER BY avg_monthly"""),
    "d06_tenure_stats": _w(CB, """
SELECT round(avg(tenure_months), 6) AS mean_tenure,
  CAST(quantile_cont(tenure_months, 0.5) AS DOUBLE) AS median_tenure,
  count(*) FILTER (WHERE tenure_months < 12) AS n_new,
  count(*) FILTER (WHERE tenure_months > 36) AS n_long_term FROM cb"""),
    "d07_value_counts": _w(CB, """
SELECT subscription_type, count(*) AS count,
  round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS pct
FROM cb GROUP BY 1 ORDER BY count DESC, 1"""),
    "d08_demographics": _w(CB, """
, w AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE gender = 'Female') AS female, count(*) FILTER (WHERE gender = 'Male') AS male,
  count(*) FILTER (WHERE senior_citizen) AS senior_citizen, count(*) FILTER (WHERE partner) AS partner,
  count(*) FILTER (WHERE dependents) AS dependents FROM cb)
SELECT 'female' AS flag, female AS count, round(female / n, 6) AS share FROM w
UNION ALL SELECT 'male', male, round(male / n, 6) FROM w
UNION ALL SELECT 'senior_citizen', senior_citizen, round(senior_citizen / n, 6) FROM w
UNION ALL SELECT 'partner', partner, round(partner / n, 6) FROM w
UNION ALL SELECT 'dependents', dependents, round(dependents / n, 6) FROM w"""),
    "d09_churn_by_contract": _w(CB, """
, g AS (SELECT subscription_type, count(*) AS n, round(avg(CAST(churn_status AS DOUBLE)), 6) AS churn_rate
  FROM cb GROUP BY 1)
SELECT *, churn_rate = max(churn_rate) OVER () AS is_highest, churn_rate = min(churn_rate) OVER () AS is_lowest
FROM g ORDER BY churn_rate DESC, subscription_type"""),
    "d10_churn_by_tenure_band": _w(CB, f"""
, b AS (SELECT *, {tenure_group_sql()} AS tg FROM cb)
SELECT 'tenure_lt_12' AS band, count(*) FILTER (WHERE tenure_months < 12) AS n,
  round(avg(CAST(churn_status AS DOUBLE)) FILTER (WHERE tenure_months < 12), 6) AS churn_rate FROM b
UNION ALL SELECT 'tenure_gt_36', count(*) FILTER (WHERE tenure_months > 36),
  round(avg(CAST(churn_status AS DOUBLE)) FILTER (WHERE tenure_months > 36), 6) FROM b
UNION ALL SELECT 'tenure_group_0', count(*) FILTER (WHERE tg = 0),
  round(avg(CAST(churn_status AS DOUBLE)) FILTER (WHERE tg = 0), 6) FROM b
UNION ALL SELECT 'tenure_group_1', count(*) FILTER (WHERE tg = 1),
  round(avg(CAST(churn_status AS DOUBLE)) FILTER (WHERE tg = 1), 6) FROM b
UNION ALL SELECT 'tenure_group_2', count(*) FILTER (WHERE tg = 2),
  round(avg(CAST(churn_status AS DOUBLE)) FILTER (WHERE tg = 2), 6) FROM b"""),
    "d11_revenue_at_risk": _w(CB, """
, s AS (SELECT round(sum(CASE WHEN churn_status THEN monthly_charges ELSE 0.0 END), 4) AS churned_revenue,
  round(sum(monthly_charges), 4) AS total_revenue FROM cb)
SELECT *, round(churned_revenue / nullif(total_revenue, 0.0), 6) AS ratio FROM s"""),
    "d11b_revenue_at_risk_by_band": _w(SCORED, f"""
, s AS (SELECT count(*) FILTER (WHERE {risk_band_sql()} = 'High Risk') AS n_high_risk,
  round(sum(CASE WHEN {risk_band_sql()} = 'High Risk' THEN monthly_charges ELSE 0.0 END), 4) AS revenue_at_risk,
  round(sum(monthly_charges), 4) AS total_revenue FROM scored)
SELECT *, round(revenue_at_risk * 100 / nullif(total_revenue, 0.0), 6) AS pct_at_risk FROM s"""),
    "d12_overview_kpis": _w(CB, """
SELECT count(*) AS total_customers, round(avg(CAST(churn_status AS DOUBLE)) * 100, 6) AS churn_pct,
  round(avg(monthly_charges), 6) AS avg_monthly, round(avg(tenure_months), 6) AS avg_tenure,
  round(sum(CASE WHEN churn_status THEN monthly_charges ELSE 0.0 END), 4) AS revenue_at_risk FROM cb"""),
    "d13_corr_with_target": _w(CB + ",\nenc AS (" + encoded_sql("cb") + ")", "\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(churn AS DOUBLE)), 6) AS corr FROM enc"
        for c in ("gender", "senior_citizen", "partner", "dependents", "tenure_months", "contract",
                  "monthly_charges", "total_charges"))),
    "d14_risk_segmentation": _w(SCORED, f"""
SELECT {risk_band_sql()} AS risk_band, count(*) AS count,
  round(avg(CAST(churn_status AS DOUBLE)), 3) AS actual_churn_rate,
  round(avg(churn_probability), 3) AS avg_predicted_prob, round(avg(monthly_charges), 3) AS avg_monthly_charges
FROM scored GROUP BY 1"""),
    "d15_histogram_fixed": _w(CB, """
SELECT 'tenure' AS histogram,
  CASE WHEN coalesce(tenure_months, 0) <= 12 THEN '0-12m' WHEN coalesce(tenure_months, 0) <= 24 THEN '13-24m'
       WHEN coalesce(tenure_months, 0) <= 48 THEN '25-48m' WHEN coalesce(tenure_months, 0) <= 60 THEN '49-60m'
       ELSE '60m+' END AS bucket,
  count(*) AS total, count(*) FILTER (WHERE churn_status) AS churned FROM cb GROUP BY 1, 2
UNION ALL
SELECT 'monthly_charges',
  CASE WHEN coalesce(monthly_charges, 0) < 30 THEN '<$30' WHEN coalesce(monthly_charges, 0) < 50 THEN '$30-50'
       WHEN coalesce(monthly_charges, 0) < 70 THEN '$50-70' WHEN coalesce(monthly_charges, 0) < 90 THEN '$70-90'
       ELSE '>$90' END,
  count(*), count(*) FILTER (WHERE churn_status) FROM cb GROUP BY 1, 2"""),
    "d16_histogram_equal_width": _w(CB, """
, s AS (SELECT CAST(min(tenure_months) AS DOUBLE) AS lo, CAST(max(tenure_months) AS DOUBLE) AS hi FROM cb),
b AS (SELECT CAST(CASE WHEN s.hi = s.lo THEN 1 ELSE least(24, floor((CAST(tenure_months AS DOUBLE) - s.lo)
    / ((s.hi - s.lo) / 24.0)) + 1) END AS INTEGER) AS bin, churn_status, s.lo, s.hi
  FROM cb CROSS JOIN s WHERE tenure_months IS NOT NULL)
SELECT bin, round(min(lo) + (bin - 1) * ((min(hi) - min(lo)) / 24.0), 6) AS bin_start,
  round(min(lo) + bin * ((min(hi) - min(lo)) / 24.0), 6) AS bin_end,
  count(*) AS total, count(*) FILTER (WHERE churn_status) AS flagged
FROM b GROUP BY bin"""),
    "d17_batch_summary": _w(SCORED, """
, j AS (SELECT c.c_custkey, s.churn_probability FROM customer c LEFT JOIN scored s ON c.c_custkey = s.customer_id),
a AS (SELECT count(*) AS requested, count(*) FILTER (WHERE churn_probability IS NOT NULL) AS succeeded,
  count(*) FILTER (WHERE churn_probability IS NULL) AS failed FROM j)
SELECT *, round(succeeded * 100.0 / nullif(requested, 0), 6) AS success_pct FROM a"""),
    "d18_risk_counts": _w(SCORED, f"SELECT {risk_level_sql()} AS risk_level, count(*) AS count FROM scored GROUP BY 1"),
    "d19_high_risk_kpis": _w(SCORED, """
SELECT count(*) FILTER (WHERE churn_probability >= 0.6) AS n_high_risk,
  round(avg(churn_probability) FILTER (WHERE churn_probability >= 0.6), 6) AS avg_probability,
  round(sum(CASE WHEN churn_probability >= 0.6 THEN monthly_charges ELSE 0.0 END), 4) AS revenue_at_risk
FROM scored"""),
}

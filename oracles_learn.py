"""DuckDB oracles for evaluation, paging and split queries."""

from __future__ import annotations

from halyard.functions import risk as rf
from oracles import CB, SCORED, _w, recommendations_sql, risk_level_sql

LAB = SCORED + """,
lab AS (SELECT customer_id, churn_probability AS p, CAST(churn_status AS INTEGER) AS label FROM scored)"""

_THR = ", ".join(f"({j}, CAST('{t!r}' AS DOUBLE))" for j, t in enumerate(rf.sweep_thresholds()))

SWEEP = LAB + f""",
thr(j, threshold) AS (VALUES {_THR}),
cnt AS (
  SELECT t.threshold, count(l.label) FILTER (WHERE l.p >= t.threshold AND l.label = 1) AS tp,
    count(l.label) FILTER (WHERE l.p >= t.threshold AND l.label = 0) AS fp
  FROM thr t CROSS JOIN lab l GROUP BY 1
),
tot AS (SELECT CAST(sum(label) AS BIGINT) AS n_pos FROM lab),
sweep AS (
  SELECT c.threshold,
    round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
    round(coalesce(tp / nullif(tp + (n_pos - tp), 0), 0.0), 6) AS recall,
    (tp + fp) * CAST(50.0 AS DOUBLE) AS campaign_cost,
    round(tp * CAST(0.3 AS DOUBLE) * CAST(500.0 AS DOUBLE), 6) AS revenue_saved,
    (n_pos - tp) * CAST(500.0 AS DOUBLE) AS revenue_lost,
    round(tp * CAST(0.3 AS DOUBLE) * CAST(500.0 AS DOUBLE)
      - ((tp + fp) * CAST(50.0 AS DOUBLE) + (n_pos - tp) * CAST(500.0 AS DOUBLE)), 6) AS net_benefit,
    tp + fp AS customers_targeted, tp AS churners_caught, n_pos - tp AS churners_missed
  FROM cnt c CROSS JOIN tot
)"""

LEARN_SQL = {
    "d31_classification_metrics": _w(LAB, """,
c AS (
  SELECT count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label <> 1) AS fp,
    count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND label <> 1) AS tn FROM lab
),
byp AS (SELECT p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM lab GROUP BY p),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_neg FROM byp),
a AS (SELECT sum(pos * (before_neg + neg * 0.5)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM cum),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS prec, tp / nullif(tp + fn, 0) AS rec FROM c)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(coalesce(prec, 0.0), 6) AS precision, round(coalesce(rec, 0.0), 6) AS recall,
  round(coalesce(2 * prec * rec / nullif(prec + rec, 0.0), 0.0), 6) AS f1, round(a.auc, 6) AS auc
FROM m CROSS JOIN a"""),
    "d32_threshold_sweep": _w(SWEEP, "SELECT * FROM sweep"),
    "d33_optimal_threshold": _w(SWEEP, "SELECT * FROM sweep ORDER BY net_benefit DESC, threshold LIMIT 1"),
    "f05_top_thresholds": _w(SWEEP, "SELECT * FROM sweep ORDER BY net_benefit DESC, threshold LIMIT 3"),
    "e07_stratified_split": _w(CB, """,
x AS (SELECT customer_id, CAST(churn_status AS INTEGER) AS churn FROM cb),
r AS (
  SELECT *, row_number() OVER (PARTITION BY churn ORDER BY md5(CAST(customer_id AS VARCHAR)), customer_id) AS rk,
    count(*) OVER (PARTITION BY churn) AS n FROM x
)
SELECT customer_id, churn, CASE WHEN rk <= floor(n * 4 / 5) THEN 'train' ELSE 'test' END AS split FROM r"""),
    "f01_page": _w(CB, """
SELECT customer_id, subscription_type, monthly_charges, tenure_months, (SELECT count(*) FROM cb) AS total_count,
  150 < (SELECT count(*) FROM cb) AS has_more
FROM cb ORDER BY customer_id LIMIT 50 OFFSET 100"""),
    "f02_high_risk_scan": _w(SCORED, f"""
SELECT customer_id, churn_probability, monthly_charges, {risk_level_sql()} AS risk_level,
  {recommendations_sql()} AS recommendations
FROM scored WHERE churn_probability >= 0.6"""),
    "f03_random_sample": _w(CB, """
SELECT customer_id, monthly_charges FROM cb ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'), customer_id LIMIT 100"""),
    "f04_top_n_risk": _w(SCORED, """
SELECT customer_id, churn_probability, monthly_charges FROM scored ORDER BY churn_probability DESC, customer_id LIMIT 20"""),
}

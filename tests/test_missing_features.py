"""Missing and non-numeric features get a probability; NaN gets no tier."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from halyard.functions import risk as rf
from halyard.operators import learn as ln


def test_missing_features_count_as_zero(spark):
    rows = [("a", 0.0, 0.0, 0), ("b", 5.0, 1.0, 1), ("c", 4.0, 0.0, 1), ("d", 1.0, 1.0, 0)]
    train = spark.createDataFrame(rows, "customer_id string, x double, y double, churn int")
    stages = [VectorAssembler(inputCols=["x", "y"], outputCol="features", handleInvalid="keep"),
              LogisticRegression(labelCol="churn", regParam=0.1)]
    model = Pipeline(stages=stages).fit(train)
    odd = spark.createDataFrame([("zero", 0.0, 0.0), ("null", None, 0.0), ("nan", float("nan"), None)],
                                "customer_id string, x double, y double")
    got = ln.score_customers(model, odd, 0.5, "m", 0.9, 2).collect()
    assert len({r["churn_probability"] for r in got}) == 1 and len({r["risk_level"] for r in got}) == 1
    assert all(r["churn_prediction"] is False for r in got)
    assert all(r["prediction_timestamp"].endswith("+00:00") for r in got)


def test_nan_is_no_tier(spark):
    row = spark.range(1).select(F.lit(float("nan")).alias("p")).select(
        rf.risk_level("p").alias("level"), rf.classify("p", 0.5).alias("churn")).first()
    assert row["level"] != "High Risk" and row["churn"] is None


def test_feature_sets():
    assert len(ln.BASE_FEATURES) == 12 and "payment_method" not in ln.BASE_FEATURES
    assert "senior_with_family" in ln.ADVANCED_FEATURES and "gender" in ln.FALLBACK_FEATURES


def test_scores_carry_the_stored_threshold_and_auc(spark):
    from halyard.plans import registry_learn as rl
    from tests.conftest import SF_SMALL

    info = rl.i07_model_info(spark, SF_SMALL).first()
    rows = rl.i06_score_customers(spark, SF_SMALL).collect()
    assert {r["optimal_threshold"] for r in rows} == {info["threshold"]}
    assert {r["model_info"]["auc_score"] for r in rows} == {info["metrics"]["auc"]}
    assert all(r["churn_prediction"] == (r["churn_probability"] >= info["threshold"]) for r in rows)

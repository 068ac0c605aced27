"""Registered evaluation, paging, sink/source and learning queries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from halyard.functions import risk as rf
from halyard.functions.numeric import rnd
from halyard.operators import boosting as bo
from halyard.operators import customers as cu
from halyard.operators import evaluation as ev
from halyard.operators import learn as ln
from halyard.operators import search as se
from halyard.operators import sentiment as st
from halyard.plans import adapters as ad
from halyard.plans.materialize import customer_dimension, materialized
from halyard.session import scratch_path
from halyard.sources import io

PAGE_LIMIT, PAGE_OFFSET = 50, 100
SAMPLE_N = 100
TOP_RISK_N = 20


def _labelled(spark, d):
    sc = ad.scored_customers(spark, d, customer_dimension(spark, d))
    return sc.withColumn("label", F.col("churn_status").cast("int"))


def d31_classification_metrics(spark, d):
    return ev.classification_metrics(_labelled(spark, d))


def d32_threshold_sweep(spark, d):
    return ev.threshold_sweep(_labelled(spark, d))


def d33_optimal_threshold(spark, d):
    return ev.optimal_threshold(ev.threshold_sweep(_labelled(spark, d)))


def f05_top_thresholds(spark, d):
    return ev.top_thresholds(ev.threshold_sweep(_labelled(spark, d)), 3)


def e07_stratified_split(spark, d):
    cb = customer_dimension(spark, d).select("customer_id", F.col("churn_status").cast("int").alias("churn"))
    return ev.stratified_split(cb, "customer_id", "churn", 0.8)


def f01_page(spark, d):
    cb = customer_dimension(spark, d).select("customer_id", "subscription_type", "monthly_charges", "tenure_months")
    return ev.page(cb, ["customer_id"], PAGE_LIMIT, PAGE_OFFSET)


def f02_high_risk_scan(spark, d):
    sc = ad.scored_customers(spark, d, customer_dimension(spark, d)).select("customer_id", "churn_probability", "monthly_charges")
    return ev.high_risk_scan(sc)


def f03_random_sample(spark, d):
    return ev.random_sample(customer_dimension(spark, d).select("customer_id", "monthly_charges"), SAMPLE_N, "customer_id")


def f04_top_n_risk(spark, d):
    sc = ad.scored_customers(spark, d, customer_dimension(spark, d)).select("customer_id", "churn_probability", "monthly_charges")
    return ev.top_n(sc, "churn_probability", TOP_RISK_N, "customer_id")


# ------------------------------------------------------- sources and sinks
def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def a01_read_customers_csv(spark, d):
    path = _scratch(spark, "customers_csv")
    io.write_csv(ad.customer_base_raw(spark, d, customer_dimension(spark, d)), path)
    return io.read_customers_csv(spark, path)


def a03_overwrite_table(spark, d):
    path = _scratch(spark, "dim_customers")
    cb = cu.clean_customers(ad.customer_base_raw(spark, d, customer_dimension(spark, d))).withColumn("customer_id", F.col("customer_id").cast("long"))
    io.overwrite_table(cb.limit(0), path, io.CUSTOMER_SCHEMA)      # create
    io.overwrite_table(cb, path, io.CUSTOMER_SCHEMA)               # truncate-and-load
    return io.read_parquet(spark, path)


def a04_write_csv(spark, d):
    path = _scratch(spark, "predictions_csv")
    sc = ad.scored_customers(spark, d, customer_dimension(spark, d)).select("customer_id", "churn_probability",
                                              rf.risk_level("churn_probability").alias("risk_level"))
    io.write_csv(sc, path)
    return spark.read.schema("customer_id long, churn_probability double, risk_level string").option("header", True).csv(path)


def a05_parquet_artifacts(spark, d):
    fb = ad.feedback(spark, d)
    path = _scratch(spark, "timeline")
    io.write_parquet(st.sentiment_timeline(fb, "W"), path)
    return _timeline6(io.read_parquet(spark, path))


def _timeline6(timeline):
    return timeline.select(*[rnd(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in timeline.schema.fields])


def a06_json_artifacts(spark, d):
    fb = ad.feedback(spark, d)
    path = _scratch(spark, "nlp_stats")
    doc = st.nlp_stats(fb, st.sentiment_timeline(fb, "W"), se.index_stats(fb))
    io.write_json_doc(doc, path)
    return st.stats_entries(io.read_json_doc(spark, path, doc.schema))


def a06b_forecast_metrics(spark, d):
    """The metrics documents of the forecast models, one per series, stored
    and read again."""
    from halyard.operators import forecast_models as fm
    from halyard.plans.materialize import daily_demand_fact

    path = _scratch(spark, "forecast_metrics")
    io.write_json_doc(fm.metrics_documents(fm.holdout_evaluation(daily_demand_fact(spark, d), 30)), path)
    return io.read_json_doc(spark, path)


# ------------------------------------------------------------- learning
def _features(spark, d):
    """The split, weighted feature table, written once per session to the
    shared checkpoint folder: iterative fits then read a short lineage
    (and survive lost executors) instead of recomputing joins per step."""
    def build():
        feats = cu.engineer_features(customer_dimension(spark, d))
        return ln.with_class_weights(ev.stratified_split(feats, "customer_id", "churn", 0.8))

    return materialized(spark, "churn_features", d, build)


def _train_test(spark, d):
    f = _features(spark, d)
    return f.filter(F.col("split") == "train"), f.filter(F.col("split") == "test")


def _tuned(spark, d):
    """The grid search's result, trained once per session and state of the
    source files and stored as one JSON document."""
    def build():
        train, _ = _train_test(spark, d)
        return spark.createDataFrame([(json.dumps(ln.tune_gbt(train).document()),)], "document string")

    return bo.Tuned.from_document(json.loads(materialized(spark, "tuned_gbt", d, build).first()["document"]))


def _stored_model(spark, d):
    """The production model as it is stored and loaded: the tuned settings
    refitted on the advanced features, with the threshold that the sweep over
    its own hold-out probabilities finds best, its metrics there, importances
    and the training statistics."""
    name = "Tuned Gradient Boosting"

    def build():
        train, test = _train_test(spark, d)
        tuned = _tuned(spark, d)
        model = bo.fit(train, ln.ADVANCED_FEATURES, tuned.setting, tuned.rounds, ln.LABEL, "customer_id", tuned.scores)
        scored = ln.probabilities(model, test, [ln.LABEL]).withColumnRenamed(ln.LABEL, "label")
        best = ev.optimal_threshold(ev.threshold_sweep(scored)).first()
        metrics = ln.evaluate(model, test, name, best["threshold"]).first().asDict()
        meta = {
            "model_type": name, "features": ln.ADVANCED_FEATURES, "threshold": best["threshold"],
            "metrics": {k: v for k, v in metrics.items() if k != "model" and v is not None},
            "feature_importances": dict(ln.feature_importances(model, ln.ADVANCED_FEATURES)),
            "training_stats": ln.training_stats(customer_dimension(spark, d)),
            "business": {"retention_cost": rf.RETENTION_COST, "churn_loss": rf.CHURN_LOSS,
                         "campaign_success_rate": rf.CAMPAIGN_SUCCESS_RATE,
                         "precision": best["precision"], "recall": best["recall"]}}
        return spark.createDataFrame([(json.dumps(model.document()), json.dumps(meta, sort_keys=True))], "model string, meta string")

    row = materialized(spark, "churn_model", d, build).first()
    return bo.Tuned.from_document(json.loads(row["model"])), json.loads(row["meta"])


def _stored_pipeline(spark, d):
    """A fitted pipeline and its side document, saved and loaded."""
    train, test = _train_test(spark, d)
    model = ln.logistic_pipeline().fit(train)
    metrics = ln.evaluate(model, test, "Logistic Regression").first().asDict()
    path = _scratch(spark, "churn_pipeline")
    io.save_model_artifact(model, path, {"model_type": "Logistic Regression", "features": ln.BASE_FEATURES, "threshold": 0.5,
                                         "metrics": {k: v for k, v in metrics.items() if k != "model" and v is not None}})
    return io.load_model_artifact(spark, path)


def _scored(model, meta, feats):
    return ln.score_customers(model, feats, meta["threshold"], meta["model_type"],
                              meta["metrics"].get("auc", 0.0), len(meta["features"]))


def _all_customers(spark, d):
    return ln.with_class_weights(cu.engineer_features(customer_dimension(spark, d)))


def a07_model_artifacts(spark, d):
    """Every customer scored by the stored production model; the saved
    pipeline comes back with the same probabilities (checked in tests)."""
    model, meta = _stored_model(spark, d)
    return _scored(model, meta, _all_customers(spark, d))


def i01_train_logistic(spark, d):
    train, test = _train_test(spark, d)
    return ln.evaluate(ln.logistic_pipeline().fit(train), test, "Logistic Regression")


def i02_train_random_forest(spark, d):
    train, test = _train_test(spark, d)
    return ln.evaluate(ln.forest_pipeline().fit(train), test, "Random Forest")


def i02b_train_fallback_forest(spark, d):
    """The serving path's 7-feature fallback forest."""
    train, test = _train_test(spark, d)
    return ln.evaluate(ln.forest_pipeline(ln.FALLBACK_FEATURES).fit(train), test, "Random Forest (fallback)")


def i03_train_gbt(spark, d):
    train, test = _train_test(spark, d)
    return ln.evaluate(ln.gbt_pipeline(ln.ADVANCED_FEATURES).fit(train), test, "Gradient Boosting")


def i04_tune_gbt(spark, d):
    _, test = _train_test(spark, d)
    return ln.evaluate(_tuned(spark, d), test, "Tuned Gradient Boosting")


def i04b_tuning_scores(spark, d):
    """Every grid point with its mean AUC over the folds."""
    kinds = "stepSize double, maxDepth int, subsamplingRate double, maxIter int, auc double, folds int"
    return spark.createDataFrame([tuple(s.values()) for s in _tuned(spark, d).scores], kinds)


def i05_compare_and_select(spark, d):
    train, test = _train_test(spark, d)
    parts = [ln.evaluate(ln.logistic_pipeline().fit(train), test, "Logistic Regression"),
             ln.evaluate(ln.forest_pipeline().fit(train), test, "Random Forest"),
             ln.evaluate(ln.gbt_pipeline().fit(train), test, "Gradient Boosting")]
    allm = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = allm.orderBy(F.desc("auc"), "model").limit(1).select(F.col("model").alias("best_model"))
    return allm.join(best, how="left", on=F.col("model") == F.col("best_model")).withColumn(
        "is_best", F.col("best_model").isNotNull()).drop("best_model")


def i06_score_customers(spark, d):
    model, meta = _stored_model(spark, d)
    return _scored(model, meta, _all_customers(spark, d))


def i07_model_info(spark, d):
    _, meta = _stored_model(spark, d)
    return ln.model_info(spark, meta["model_type"], meta["features"], meta["threshold"], meta["metrics"])


def f06_top_features(spark, d):
    model, _ = _stored_model(spark, d)
    return ln.top_features(spark, model, ln.ADVANCED_FEATURES, 10)


def k01_stream_score(spark, d):
    from halyard.streaming import jobs

    model, meta = _stored_model(spark, d)
    feats = cu.engineer_features(customer_dimension(spark, d)).select("customer_id", *ln.ADVANCED_FEATURES)
    src, sink, ck = _scratch(spark, "k1_src"), _scratch(spark, "k1_sink"), _scratch(spark, "k1_ckpt")
    feats.repartition(4).write.mode("overwrite").parquet(src)
    q = jobs.stream_score(spark, model, src, feats.schema, sink, ck, meta["threshold"], model_name=meta["model_type"],
                          auc=meta["metrics"].get("auc", 0.0), n_features=len(meta["features"]))
    q.awaitTermination()
    return spark.read.parquet(sink)


def k02_stream_sentiment_timeline(spark, d):
    from halyard.streaming import jobs

    ev = ad.event_sentiment(spark, d).select("event_id", "ts", "sentiment_score", "sentiment_label")
    src, sink, ck = _scratch(spark, "k2_src"), _scratch(spark, "k2_sink"), _scratch(spark, "k2_ckpt")
    ev.repartition(4).write.mode("overwrite").parquet(src)
    q = jobs.stream_sentiment_timeline(spark, src, ev.schema, sink, ck, period="1 day", watermark="2 days")
    q.awaitTermination()
    return _timeline6(jobs.read_timeline(spark, sink))


def k01b_stream_current(spark, d):
    """Raw records of every customer, each in two versions that arrive newest
    first and then once more: one current prediction a customer."""
    from halyard.streaming import current_scores as cs

    stored_model = _stored_model(spark, d)
    raw = ad.customer_base_raw(spark, d, customer_dimension(spark, d))
    day = F.pmod(F.xxhash64(cs.KEY), F.lit(20)).cast("int")
    now = raw.withColumn(cs.TIME, F.timestamp_add("DAY", day, F.lit("2024-02-01").cast("timestamp")))
    before = now.withColumns({cs.TIME: F.timestamp_add("DAY", F.lit(-30), cs.TIME), "MonthlyCharges": F.lit("1.0"), "Contract": F.lit("Two year")})
    src, sink, ck = _scratch(spark, "k1b_src"), _scratch(spark, "k1b_sink"), _scratch(spark, "k1b_ckpt")
    for part in (now, before, now):
        part.select(*cs.RECORD.names).write.mode("append").parquet(src)
    cs.stream_current_scores(spark, lambda: stored_model, src, sink, ck, delay="60 days").awaitTermination()
    return cs.read_current_scores(spark, sink)


QUERIES = {name: fn for name, fn in list(globals().items())
           if callable(fn) and name[:1] in "adefik" and name[1:3].isdigit()}

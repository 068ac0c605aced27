"""K1 on raw records, K2's snapshots and B7's dictionary."""

import pytest

from halyard.operators import customers as cu
from halyard.operators import label_codes as lc
from halyard.operators import learn as ln
from halyard.operators import sentiment as st
from halyard.plans import adapters as ad
from halyard.streaming import current_scores as cs
from halyard.streaming import jobs
from tests.conftest import SF_SMALL

FIELDS = dict(gender="Female", SeniorCitizen="0", Partner="Yes", Dependents="No", tenure="12", Contract="One year",
              PaymentMethod="Mailed check", MonthlyCharges="50.0", TotalCharges="600.0", Churn="No")
STATS = {"median": 65.0, "min": 20.0, "max": 120.0}


def record(customer, when, **over):
    f = {**FIELDS, **over}
    return (customer, *[f[c] for c in cs.RECORD.names[1:-1]], when)


def written(spark, folder, *records):
    day = ", ".join(f"{c} string" for c in cs.RECORD.names)
    rows = spark.createDataFrame(list(records), day)
    rows.withColumn(cs.TIME, rows[cs.TIME].cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def model(spark):
    base = ad.customer_base(spark, SF_SMALL)
    rows = ln.with_class_weights(cu.engineer_features(base))
    return ln.logistic_pipeline(max_iter=20).fit(rows)


@pytest.fixture
def run(spark, tmp_path, model):
    """Runs the stream over what is in the source and gives the current view."""
    src, sink, ck = (f"{tmp_path}/{x}" for x in ("src", "sink", "ck"))
    asked = []

    def go(*records, name="one", **kw):
        written(spark, src, *records)
        meta = {"training_stats": STATS, "threshold": 0.5, "model_type": name, "metrics": {"auc": 0.7}, "features": ln.BASE_FEATURES}

        def current():
            asked.append(name)
            return model, meta

        cs.stream_current_scores(spark, current, src, sink, ck, **kw).awaitTermination()
        return {r["customer_id"]: r for r in cs.read_current_scores(spark, sink).collect()}

    go.asked = asked
    return go


def test_late_and_repeated_records_give_one_prediction(spark, run, model):
    new = record("A", "2024-03-10 00:00:00", tenure="40", Contract="Two year")
    rows = run(new, new, record("A", "2024-03-09 00:00:00"), record("B", "2024-03-10 00:00:00"))
    assert set(rows) == {"A", "B"} and rows["A"]["recorded_at"].day == 10
    feats = cu.engineer_features(cu.clean_customers(spark.createDataFrame([new], cs.RECORD.names[:-1] + ["t"])), 65.0, 20.0, 120.0)
    want = ln.score_customers(model, feats, 0.5, "one", 0.7, len(ln.BASE_FEATURES)).first()
    assert rows["A"]["churn_probability"] == want["churn_probability"]
    # an older and a repeated record change nothing; a newer one takes over with the model then in force
    again = run(record("A", "2024-03-09 12:00:00", tenure="1"), new, record("B", "2024-03-11 00:00:00"), name="two")
    assert again["A"]["churn_probability"] == want["churn_probability"] and again["A"]["model_info"]["model_name"] == "one"
    assert again["B"]["model_info"]["model_name"] == "two" and again["B"]["recorded_at"].day == 11


def test_ties_nulls_and_order_of_arrival(run):
    a, b = record("A", "2024-03-10 00:00:00", tenure="5"), record("A", "2024-03-10 00:00:00", tenure=None)
    first = run(b, a, record(None, "2024-03-10 00:00:00"), record("C", None))
    assert set(first) == {"A"}
    again = run(b)
    assert again["A"]["churn_probability"] == first["A"]["churn_probability"] and again["A"]["prediction_timestamp"] == first["A"]["prediction_timestamp"]


def test_silent_customers_expire(run):
    kw = dict(delay="1 hour", keep_ms=5 * 86_400_000)
    assert set(run(record("A", "2024-03-01 00:00:00"), record("B", "2024-03-01 00:00:00"), **kw)) == {"A", "B"}
    run(record("B", "2024-03-20 00:00:00"), **kw)
    assert set(run(record("B", "2024-03-21 00:00:00"), **kw)) == {"B"}
    assert set(run(record("A", "2024-03-21 00:00:00"), **kw)) == {"A", "B"}


def test_snapshot_counts_once_its_pointer_is_there(spark, tmp_path, monkeypatch):
    sink, snap = str(tmp_path / "sink"), str(tmp_path / "snap")
    batch = "select date'2024-01-01' + cast(id as int) as period, id as n_positive, 1L as n_negative, 0L as n_neutral, 0.5D as sum_score, id + 1 as total_count from range({a}, {b})"
    put = lambda k, a, b: spark.sql(batch.format(a=a, b=b)).write.parquet(f"{sink}/batch_id={k}")
    view = lambda: sorted(map(tuple, jobs.read_timeline(spark, sink, snap).collect()))
    plain = lambda: sorted(map(tuple, jobs.read_timeline(spark, sink).collect()))
    put(0, 1, 4)
    assert jobs.compact_timeline(spark, sink, snap) == 1 and view() == plain()
    put(1, 3, 7)
    with monkeypatch.context() as m:
        m.setattr(jobs, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            jobs.compact_timeline(spark, sink, snap)
    assert view() == plain() and len(plain()) == 6
    assert jobs.compact_timeline(spark, sink, snap) == 2 and view() == plain()
    put(2, 6, 9)
    assert jobs.compact_timeline(spark, sink, snap) == 3 and view() == plain()
    import os
    assert sorted(f for f in os.listdir(snap) if f.startswith("version")) == ["version=2", "version=3"]


def test_label_codes(spark, tmp_path):
    rows = [("b", "x y", 1), ("a", None, 2), (None, "é", 3), ("b", "", 4), ("Z", "x y", 5)]
    df = spark.createDataFrame(rows, "kind string, `odd name` string, n int")
    columns = lc.text_columns(df)
    lc.fit_codes(df, columns).write.parquet(f"{tmp_path}/codes")
    codes = spark.read.parquet(f"{tmp_path}/codes")
    got = {r["n"]: (r["kind_code"], r["odd name_code"]) for r in lc.encode_labels(df, codes, columns).collect()}
    assert got == {1: (2, 1), 2: (1, -1), 3: (-1, 2), 4: (2, 0), 5: (0, 1)}
    other = spark.createDataFrame([("new", "x y", 9)], df.schema)
    other.write.parquet(f"{tmp_path}/new")
    seen = lc.encode_labels(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/new"), codes, columns)
    seen.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    row = spark.read.parquet(f"{tmp_path}/out").first()
    assert (row["kind_code"], row["odd name_code"]) == (lc.UNSEEN, 1)
    assert lc.encode_labels(df, lc.fit_codes(df.limit(0), columns), columns).filter("kind_code = -1").count() == 5


def test_stats_document_without_rows_or_trend(spark):
    fb = ad.feedback(spark, SF_SMALL)
    index = fb.selectExpr("'none' AS backend", "1L AS n_documents").limit(1)
    one = fb.limit(1).withColumns({"category": st.F.lit(None).cast("string")})
    doc = st.nlp_stats(one, st.sentiment_timeline(one, "W"), index).first()
    assert doc["trend"] is None and doc["category_distribution"] == {} and list(doc["sentiment_distribution"].values()) == [100.0]
    empty = st.nlp_stats(fb.limit(0), st.sentiment_timeline(fb, "W"), index).first()
    assert empty["total_feedback"] == 0 and empty["avg_sentiment_score"] == 0.0 and empty["sentiment_distribution"] == {}

"""Structured Streaming jobs (K1, K2).

Both jobs keep their checkpoints and sinks under the shared folder the
cluster names in ``spark.checkpoint.dir`` (see ``halyard.session``), so a
restarted driver or lost executor resumes exactly where it stopped.

* K1 ``stream_score``: new customer feature files -> fitted model ->
  scored rows appended to a parquet sink (exactly-once file sink).
* K2 ``stream_sentiment_timeline``: sentiment events -> watermark ->
  tumbling-window counts in update mode; every micro-batch writes its
  updated windows under ``batch_id=N`` (overwrite, so retries are
  idempotent). The current timeline is the latest version of every window.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W



def stream_score(spark: SparkSession, model, source_dir: str, schema, sink_dir: str, checkpoint: str,
                 threshold: float = 0.5, available_now: bool = True, model_name: str = "model",
                 auc: float = 0.0, n_features: int = 0):
    """K1: score every new feature file as it lands, with the same
    prediction record as the batch and manual paths (I6)."""
    from halyard.operators.learn import score_customers

    src = spark.readStream.schema(schema).parquet(source_dir)
    out = score_customers(model, src, threshold, model_name, auc, n_features)
    w = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.outputMode("append").start()


def _window_counts(events: DataFrame, ts_col: str, period: str, watermark: str) -> DataFrame:
    ts = F.col(ts_col).cast("timestamp")
    ev = events.withColumn("_ts", ts).withWatermark("_ts", watermark)
    # weeks start on Monday: tumbling 7-day windows offset from the epoch (a Thursday)
    start = "4 days" if period == "7 days" else None
    win = F.window("_ts", period, period, start) if start else F.window("_ts", period)
    lab = F.col("sentiment_label")
    return ev.groupBy(win.alias("w")).agg(
        F.count_if(lab == "positive").alias("n_positive"),
        F.count_if(lab == "negative").alias("n_negative"),
        F.count_if(lab == "neutral").alias("n_neutral"),
        F.sum("sentiment_score").alias("sum_score"),
        F.count(F.lit(1)).alias("total_count"),
    ).select(F.to_date(F.col("w.start")).alias("period"), "n_positive", "n_negative", "n_neutral",
             "sum_score", "total_count")


def stream_sentiment_timeline(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint: str,
                              period: str = "1 day", watermark: str = "2 days", ts_col: str = "ts",
                              available_now: bool = True):
    """K2: keep the sentiment timeline current; rows later than the
    watermark are dropped."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    counts = _window_counts(src, ts_col, period, watermark)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            os.path.join(sink_dir, f"batch_id={batch_id}"))

    w = counts.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


#: Folder with an empty file per finished snapshot.
POINTERS = "_pointers"
_COUNT_COLS = ("n_positive", "n_negative", "n_neutral", "sum_score", "total_count")


def _latest_counts(raw: DataFrame) -> DataFrame:
    """The newest version of every window (max batch_id wins)."""
    return raw.groupBy("period").agg(
        F.max_by(F.struct(*_COUNT_COLS, "batch_id"), F.col("batch_id")).alias("s")
    ).select("period", "s.*")


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _snapshot(spark: SparkSession, snapshot_dir: str) -> int:
    """The number of the newest snapshot that has its pointer, or 0."""
    fs, pointers = _folder(spark, os.path.join(snapshot_dir, POINTERS))
    return max((int(e.getPath().getName()) for e in fs.listStatus(pointers)), default=0) if fs.exists(pointers) else 0


def _version(snapshot_dir: str, number: int) -> str:
    return os.path.join(snapshot_dir, f"version={number}")


def compact_timeline(spark: SparkSession, sink_dir: str, snapshot_dir: str) -> int:
    """Fold every micro-batch written so far into a new snapshot (one row per
    period, with the batch it came from) and return its number. Readers then
    combine the snapshot with newer batches only; old batch folders can be
    expired by retention.

    A snapshot gets its own folder and counts once its pointer, an empty file,
    is there. A run that dies before leaves the last snapshot in force, and
    the next run writes the same folder again. The snapshot before stays for
    readers that have begun; older ones are deleted. One run at a time."""
    held = _snapshot(spark, snapshot_dir)
    raw = spark.read.parquet(sink_dir)
    if held:
        raw = raw.unionByName(spark.read.parquet(_version(snapshot_dir, held)))
    _latest_counts(raw).write.mode("overwrite").parquet(_version(snapshot_dir, held + 1))
    _point(spark, snapshot_dir, held + 1)
    if held > 1:
        fs, old = _folder(spark, _version(snapshot_dir, held - 1))
        fs.delete(old, True)
    return held + 1


def _point(spark: SparkSession, snapshot_dir: str, number: int) -> None:
    fs, pointer = _folder(spark, os.path.join(snapshot_dir, POINTERS, str(number)))
    fs.createNewFile(pointer)


def read_timeline(spark: SparkSession, sink_dir: str, snapshot_dir: str | None = None) -> DataFrame:
    """The current timeline from K2's sink: the latest version of every
    window (one row per period), then shares, net and the 3-period trend
    over periods (already aggregated). With a snapshot, only batches newer
    than it are read (partition pruning on ``batch_id``)."""
    raw = spark.read.parquet(sink_dir)
    if snapshot_dir and (number := _snapshot(spark, snapshot_dir)):
        snap = spark.read.parquet(_version(snapshot_dir, number))
        newer = raw.filter(F.col("batch_id") > snap.agg(F.max("batch_id")).scalar())
        raw = snap.unionByName(newer.select("period", *_COUNT_COLS, "batch_id"))
    latest = _latest_counts(raw)
    n = F.col("total_count")
    tl = latest.select(
        "period",
        (F.col("n_positive") * 100.0 / n).alias("positive_pct"),
        (F.col("n_negative") * 100.0 / n).alias("negative_pct"),
        (F.col("n_neutral") * 100.0 / n).alias("neutral_pct"),
        (F.col("sum_score") / n).alias("avg_score"),
        "total_count",
    ).withColumn("net_sentiment", F.col("positive_pct") - F.col("negative_pct"))
    return tl.withColumn("trend", F.avg("net_sentiment").over(W.orderBy("period").rowsBetween(-2, 0)))

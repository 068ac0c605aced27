"""Feedback sentiment: scoring (J1-J4), distributions (D20-D24), timeline
and trend (D25, D26, E1).

Scoring is native column algebra (token sets and array intersections), so it
runs inside whole-stage codegen. An external model plugs in through
``score_with_model`` as an Arrow-batched pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from halyard.functions import text as tx
from halyard.functions.numeric import rnd
from halyard.session import spread_partitions

LABELS = ("positive", "negative", "neutral")
TREND_CUT = 5.0
TREND_WINDOW = 4
FREQ_UNITS = {"D": "day", "W": "week", "M": "month"}


def lexicon_scores(df: DataFrame, text_col: str, positive=tx.POSITIVE_WORDS, negative=tx.NEGATIVE_WORDS) -> DataFrame:
    """Word-count sentiment of every row."""
    s = tx.lexicon_sentiment(text_col, positive, negative)
    return spread_partitions(df).withColumn("_s", s).select(
        *[c for c in df.columns],
        F.col("_s.label").alias("label"), F.col("_s.score").alias("score"),
        F.col("_s.positive").alias("p_positive"), F.col("_s.neutral").alias("p_neutral"),
        F.col("_s.negative").alias("p_negative"),
        F.col("_s.n_pos").alias("n_pos"), F.col("_s.n_neg").alias("n_neg"),
    )


def score_feedback(df: DataFrame, text_col: str = "feedback_text", label_col: str = "existing_label",
                   score_col: str = "existing_score") -> DataFrame:
    """Fill missing labels with the lexicon scorer; rows that already
    carry a label keep it (no re-scoring)."""
    s = tx.lexicon_sentiment(text_col)
    have = F.col(label_col).isNotNull()
    return df.withColumns({
        "sentiment_label": F.when(have, F.col(label_col)).otherwise(s.getField("label")),
        "sentiment_confidence": F.when(have, F.col(score_col)).otherwise(s.getField("score")),
        "was_scored": ~have,
    })


def score_with_model(df: DataFrame, text_col: str, predict: Callable) -> DataFrame:
    """J4 model hook: ``predict(pandas.Series[str]) -> DataFrame[label, score]``
    runs per Arrow batch inside the executors on whole texts (a model with a
    length limit splits them itself); labels go through the alias table and
    are expanded into three-way scores (J3)."""
    schema = T.StructType([T.StructField("raw_label", T.StringType()), T.StructField("confidence", T.DoubleType())])

    @F.pandas_udf(schema)
    def _infer(texts: pd.Series) -> pd.DataFrame:
        out = predict(texts.fillna(""))
        return pd.DataFrame({"raw_label": out["label"].astype(str), "confidence": out["score"].astype(float)})

    x = df.withColumn("_m", _infer(F.col(text_col)))
    lab = tx.normalise_label(F.col("_m.raw_label"))
    return x.withColumns({
        "sentiment_label": lab,
        "sentiment_confidence": F.col("_m.confidence"),
        "scores": tx.expand_confidence(lab, F.col("_m.confidence")),
    }).drop("_m")


def _pct(cond) -> F.Column:
    return F.avg(cond.cast("double")) * 100


def sentiment_distribution(df: DataFrame, label_col: str = "sentiment_label") -> DataFrame:
    """Percent of rows per label, 1 dp (total as a scalar subquery)."""
    g = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return g.select(label_col, "count", rnd(F.col("count") * 100.0 / total, 1).alias("pct"))


def sentiment_by_segment(df: DataFrame, segment: str, label_col: str = "sentiment_label") -> DataFrame:
    """Percent of each label within each segment value, 1 dp."""
    g = df.groupBy(segment, label_col).agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(W.partitionBy(segment))
    return g.select(segment, F.col(label_col).alias("sentiment"), rnd(F.col("count") * 100.0 / tot, 1).alias("percentage"))


def feedback_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value of ``col``."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def recent_negative_pct(df: DataFrame, days: int = 30, ts_col: str = "created_at",
                        label_col: str = "sentiment_label") -> DataFrame:
    """Negative share among rows no older than ``days`` before the
    latest row (latest = scalar subquery)."""
    latest = df.agg(F.max(ts_col)).scalar()
    recent = df.filter(F.col(ts_col) >= F.timestamp_add("DAY", F.lit(-days), latest))
    return recent.agg(
        F.count(F.lit(1)).alias("n_recent"),
        rnd(_pct(F.col(label_col) == "negative"), 1).alias("negative_pct"),
    )


def sentiment_timeline(df: DataFrame, freq: str = "W", ts_col: str = "created_at",
                       label_col: str = "sentiment_label", score_col: str = "sentiment_score",
                       by: list[str] | None = None) -> DataFrame:
    """D25 + E1: per period (D/W/M; weeks start on Monday) label shares,
    mean score, count, net = positive - negative, and the trailing 3-period
    mean of net. Rows are aggregated first; the trend window then runs over
    one row per period."""
    unit = FREQ_UNITS[freq]
    by = by or []
    period = F.to_date(F.date_trunc(unit, F.col(ts_col).cast("timestamp")))
    g = df.groupBy(*by, period.alias("period")).agg(
        _pct(F.col(label_col) == "positive").alias("positive_pct"),
        _pct(F.col(label_col) == "negative").alias("negative_pct"),
        _pct(F.col(label_col) == "neutral").alias("neutral_pct"),
        F.avg(score_col).alias("avg_score"),
        F.count(F.lit(1)).alias("total_count"),
    )
    g = g.withColumn("net_sentiment", F.col("positive_pct") - F.col("negative_pct"))
    w = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("period").rowsBetween(-2, 0)
    return g.withColumn("trend", F.avg("net_sentiment").over(w))


def detect_trend(timeline: DataFrame, window: int = TREND_WINDOW, by: list[str] | None = None) -> DataFrame:
    """Mean net sentiment of the last ``window`` periods against the
    first max(1, n - window); +-5 points decide improving / worsening."""
    by = by or []
    part = W.partitionBy(*by) if by else W.partitionBy()
    x = timeline.select(*by, "period", "net_sentiment").withColumns({
        "_asc": F.row_number().over(part.orderBy("period")),
        "_desc": F.row_number().over(part.orderBy(F.desc("period"))),
    }).withColumn("_n", F.max("_asc").over(part))
    agg = x.groupBy(*by).agg(
        F.max("_n").alias("n_periods"),
        F.avg(F.when(F.col("_desc") <= window, F.col("net_sentiment"))).alias("recent_avg"),
        F.avg(F.when(F.col("_asc") <= F.greatest(F.lit(1), F.col("_n") - window), F.col("net_sentiment"))).alias("older_avg"),
    )
    delta = F.col("recent_avg") - F.col("older_avg")
    enough = F.col("n_periods") >= 2
    direction = (F.when(~enough, "stable").when(delta > TREND_CUT, "improving")
                 .when(delta < -TREND_CUT, "worsening").otherwise("stable"))
    return agg.select(
        *by, "n_periods", direction.alias("direction"),
        F.when(enough, rnd(F.abs(delta), 1)).otherwise(F.lit(0.0)).alias("magnitude"),
        F.when(enough, rnd("recent_avg", 1)).alias("recent_avg"),
        F.when(enough, rnd("older_avg", 1)).alias("older_avg"),
    )


def nlp_stats(df: DataFrame, timeline: DataFrame, index: DataFrame) -> DataFrame:
    """One stats document: total, shares of the labels in percent,
    category and channel counts as maps, mean score (4 dp), index statistics
    (J9) and the trend, null for a timeline of one period. Nulls of a column
    count in none of its entries. Maps hold a column's few values."""
    def dist(col, name, share=False):
        g = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        g = g.agg(F.sum("n").alias("total"), F.collect_list(F.struct("k", "n")).alias("x"))
        one = lambda e: F.struct(e["k"], rnd(e["n"] * 100.0 / F.col("total"), 1) if share else e["n"])
        return g.select(F.map_from_entries(F.transform("x", one)).alias(name))

    head = df.agg(F.count(F.lit(1)).alias("total_feedback"), F.coalesce(rnd(F.avg("sentiment_score"), 4), F.lit(0.0)).alias("avg_sentiment_score"))
    indexed = index.select(F.struct("backend", "n_documents").alias("index_stats"))
    trend = detect_trend(timeline).select(F.when(F.col("n_periods") > 1, F.struct("direction", "magnitude", "recent_avg", "older_avg")).alias("trend"))
    out = head
    for part in (dist("sentiment_label", "sentiment_distribution", True), dist("category", "category_distribution"),
                 dist("channel", "channel_distribution"), indexed, trend):
        out = out.crossJoin(part)  # every part is exactly one row
    return out


def stats_entries(doc: DataFrame) -> DataFrame:
    """The stats document as rows (section, key, value, text)."""
    number = lambda c: F.col(c).cast("double")
    entry = lambda s, k, v, t=None: F.struct(F.lit(s).alias("section"), k.alias("key"), v.alias("value"), (F.lit(None).cast("string") if t is None else t).alias("text"))

    def entries(c):
        return F.transform(F.map_entries(c), lambda e: entry(c, e["key"], e["value"].cast("double")))

    maps = [entries(c) for c in ("sentiment_distribution", "category_distribution", "channel_distribution")]
    single = F.array(
        entry("total_feedback", F.lit("total"), number("total_feedback")),
        entry("avg_sentiment_score", F.lit("mean"), number("avg_sentiment_score")),
        entry("index_stats", F.lit("n_documents"), number("index_stats.n_documents"), F.col("index_stats.backend")),
        *[entry("trend", F.lit(k), number(f"trend.{k}"), F.col("trend.direction")) for k in ("magnitude", "recent_avg", "older_avg")],
    )
    return doc.select(F.explode(F.concat(single, *maps)).alias("e")).select("e.*")

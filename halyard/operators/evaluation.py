"""Classifier evaluation and business thresholds (D31-D33, F5), paging,
sampling and top-k (F1-F4) and the deterministic stratified split (E7).

Scale design: nothing here sorts or windows raw rows globally.
* Exact AUC aggregates to one row per distinct score, then takes running
  sums over ranges of those scores (one row per range carries the offsets).
* The threshold sweep is a histogram over the 16 thresholds (one partial
  aggregation) plus cumulative sums over <= 17 bins.
* The stratified split places rows by (class, md5) over ranges and
  subtracts where each class starts.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.functions import risk as rf
from halyard.functions.numeric import rnd
from halyard.operators.ranking import with_position, with_running_sums


# ------------------------------------------------------------ metrics
def _score_counts(scored: DataFrame, p: str, label: str) -> DataFrame:
    """One row per distinct score with its positive / negative counts: the
    single pass over raw rows that every metric below derives from."""
    return scored.groupBy(F.col(p).cast("double").alias("_p")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"),
        F.count_if(F.col(label) == 0).alias("neg0"))


def _ranked_counts(scored: DataFrame, p: str, label: str) -> DataFrame:
    """The counts of every score with the negatives below it (``below``),
    summed over ranges of the score; any number of distinct scores."""
    by_p = with_running_sums(_score_counts(scored, p, label), [F.asc("_p")], {"_upto": "neg0"})
    return by_p.withColumn("below", F.col("_upto") - F.col("neg0"))


def _auc() -> F.Column:
    return F.sum(F.col("pos") * (F.col("below") + F.col("neg0") * 0.5)) / F.nullif(F.sum("pos") * F.sum("neg0"), F.lit(0))


def exact_auc(scored: DataFrame, p: str = "churn_probability", label: str = "label") -> DataFrame:
    """Area under the ROC curve with ties counted half (Mann-Whitney)."""
    return _ranked_counts(scored, p, label).agg(_auc().alias("auc"))


def classification_metrics(scored: DataFrame, p: str = "churn_probability", label: str = "label",
                           threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 at ``threshold`` and exact AUC:
    one pass over the rows to counts per score, one over the ranked counts."""
    pred = F.col("_p") >= threshold
    missed = ~pred | F.col("_p").isNull()
    c = _ranked_counts(scored, p, label).agg(
        F.sum(F.when(pred, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(pred, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(missed, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(missed, F.col("neg")).otherwise(0)).alias("tn"),
        _auc().alias("_auc"),
    )
    prec = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    rec = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return c.select(
        "tp", "fp", "fn", "tn",
        rnd((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"),
        rnd(F.coalesce(prec, F.lit(0.0)), 6).alias("precision"),
        rnd(F.coalesce(rec, F.lit(0.0)), 6).alias("recall"),
        rnd(F.coalesce(2 * prec * rec / F.nullif(prec + rec, F.lit(0.0)), F.lit(0.0)), 6).alias("f1"),
        rnd("_auc", 6).alias("auc"),
    )


def threshold_sweep(scored: DataFrame, p: str = "churn_probability", label: str = "label",
                    thresholds: list[float] | None = None) -> DataFrame:
    """Per threshold tp/fp/fn, precision, recall and the business
    outcome (campaign cost, revenue saved and lost, net benefit)."""
    thr = sorted(thresholds or rf.sweep_thresholds())
    arr = F.array(*[F.lit(float(t)) for t in thr])
    idx = F.size(F.filter(arr, lambda t: t <= F.col(p)))   # predicted positive for thresholds[:idx]
    hist = scored.groupBy(idx.alias("_i")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    spark = scored.sparkSession
    tdf = spark.createDataFrame([(j, float(t)) for j, t in enumerate(thr)], "j int, threshold double")
    # total positives: a window over the <= 17 histogram rows (no second pass)
    hist = hist.withColumn("_total_pos", F.sum("pos").over(W.partitionBy()))
    # bounded join: <= len(thr) x (len(thr) + 1) aggregated rows
    j = F.broadcast(tdf).join(hist, F.col("_i") > F.col("j"), "left")
    agg = j.groupBy("j", "threshold").agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    totals = hist.agg(F.coalesce(F.max("_total_pos"), F.lit(0)).alias("total_pos"))
    agg = agg.crossJoin(totals)  # 16 rows x 1 row
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("total_pos") - tp
    return agg.select(
        "threshold",
        rnd(F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)), 6).alias("precision"),
        rnd(F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0)), 6).alias("recall"),
        ((tp + fp) * rf.RETENTION_COST).alias("campaign_cost"),
        rnd(tp * rf.CAMPAIGN_SUCCESS_RATE * rf.CHURN_LOSS, 6).alias("revenue_saved"),
        (fn * rf.CHURN_LOSS).alias("revenue_lost"),
        rnd(tp * rf.CAMPAIGN_SUCCESS_RATE * rf.CHURN_LOSS - ((tp + fp) * rf.RETENTION_COST + fn * rf.CHURN_LOSS), 6).alias("net_benefit"),
        (tp + fp).alias("customers_targeted"), tp.alias("churners_caught"), fn.alias("churners_missed"),
    )


def optimal_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the highest net benefit."""
    return sweep.orderBy(F.desc("net_benefit"), F.asc("threshold")).limit(1)


def top_thresholds(sweep: DataFrame, n: int = 3) -> DataFrame:
    """the ``n`` best thresholds by net benefit."""
    return sweep.orderBy(F.desc("net_benefit"), F.asc("threshold")).limit(n)


# ------------------------------------------------------ paging & sampling
def page(df: DataFrame, order_by: list[str], limit: int, offset: int = 0) -> DataFrame:
    """one page in a stable order plus total count and has_more. The
    page is a bounded TakeOrdered (offset + limit rows per task)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order_by).offset(offset).limit(limit)
    return rows.withColumns({"total_count": total, "has_more": F.lit(offset + limit) < total})


def high_risk_scan(scored: DataFrame, threshold: float = rf.HIGH_RISK_SCAN_THRESHOLD, p: str = "churn_probability") -> DataFrame:
    """every customer at or above the threshold, with tier and actions."""
    return scored.filter(F.col(p) >= threshold).withColumns({
        "risk_level": rf.risk_level(p), "recommendations": rf.recommendations(p)})


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """a seeded, reproducible sample of ``n`` rows (hash order)."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def top_n(df: DataFrame, col: str, n: int, key: str) -> DataFrame:
    """highest ``col`` first (ties by key)."""
    return df.orderBy(F.desc(col), F.asc(key)).limit(n)


# ------------------------------------------------------ stratified split
def stratified_split(df: DataFrame, key: str, label: str, train_frac: float = 0.8) -> DataFrame:
    """Deterministic stratified split. Within each class, rows are
    ordered by (md5(key), key); the first floor(frac * n_class) are
    'train'. Places come from ranges over all rows, so no class is ever
    sorted in a single task."""
    frac = Fraction(train_frac).limit_denominator(1000)
    num, den = frac.numerator, frac.denominator
    placed = with_position(df.withColumn("_h", F.md5(F.col(key).cast("string"))), [F.asc(label), F.asc("_h"), F.asc(key)], "_at")
    classes = placed.groupBy(label).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = classes.select(F.col(label).alias("_label"), "_first", "_n")
    x = placed.join(F.broadcast(own), F.col(label).eqNullSafe(F.col("_label")))  # a row per class
    quota = F.floor(F.col("_n") * num / den)
    return x.select(*df.columns, F.when(F.col("_at") - F.col("_first") < quota, "train").otherwise("test").alias("split"))

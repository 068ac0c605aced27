import math

import pytest
from pyspark.sql import functions as F

from halyard.operators import quantiles as q

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    h = F.xxhash64("id")
    return spark.range(0, 5000, 1, 6).select(
        (F.pmod(h, F.lit(1_000_003)) / 7.0).alias("wide"),
        F.pmod(h, F.lit(5)).alias("few"),
        F.when(F.col("id") % 3 > 0, F.exp(F.pmod(h, F.lit(1400)) - 700.0)).alias("steep"),
        F.when(F.col("id") % 2 == 0, F.lit(42.5)).otherwise(F.col("id") * 1.0).alias("hot"),
        F.when(F.col("id") == 7, 1.5e308).when(F.col("id") == 8, -1.5e308).otherwise(F.sin("id")).alias("far"),
        F.lit(None).cast("double").alias("none"), F.lit(3.25).alias("same"))


def test_equal_to_percentile(values):
    names = values.columns
    got = q.exact_quantiles(values, [F.col(c) for c in names], SHARES)
    want = values.agg(*[F.percentile(c, SHARES).alias(c) for c in names]).first()
    for name, own in zip(names, got):
        expected = want[name] if want[name] is not None else [None] * len(SHARES)
        assert all(a == b if b is None else a == pytest.approx(b, rel=1e-12) for a, b in zip(own, expected)), name


def test_counters_don_t_grow_with_the_rows(values, monkeypatch):
    seen = []
    narrow = q._narrow
    monkeypatch.setattr(q, "_narrow", lambda x, open_, steep: (seen.append(len(open_)), narrow(x, open_, steep))[1])
    q.exact_quantiles(values, [F.col("wide")], [0.5])
    assert len(seen) <= 5 and max(seen) <= 2  # intervals, each with BINS counters


def test_steep_values_need_few_passes(values, monkeypatch):
    passes = []
    narrow = q._narrow
    monkeypatch.setattr(q, "_narrow", lambda *a: (passes.append(1), narrow(*a))[1])
    q.exact_quantiles(values, [F.col("steep")], [0.05, 0.5])
    assert len(passes) <= 8


def test_nothing_one_value_and_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None)], "a double, b double")
    assert q.exact_quantiles(df, [F.col("a"), F.col("b")], [0.5, 1.0]) == [[1.0, 1.0], [None, None]]
    assert q.exact_quantiles(df.limit(0), [F.col("a")], [0.5]) == [[None]]


def test_ranks():
    assert q.ranks(5, 0.5) == (2, 3, 0.0) and q.ranks(1, 0.9) == (0, 0, 0.0) and q.ranks(4, 1.0)[:2] == (3, 3)
    low, high, part = q.ranks(4, 0.5)
    assert (low, high) == (1, 2) and math.isclose(part, 0.5)

"""Global order without a single sorted task: positions and running sums over
any number of rows.

The rows are dealt to ranges of the order key, sorted inside each range and
written once. One row per range (its count and sums) then gives the offset of
every range; the rest is arithmetic inside the range. Nothing depends on how
many ranges there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.session import scratch_path, shuffles_dropped

_AT, _RANGE = "__at", "__range"
#: Bits of `monotonically_increasing_id` that count rows inside a partition.
_ROW_BITS = 33


def _placed(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    """`df` in ranges of `order`, with the range and the place in it. Written
    and read back, so that a lost executor can't deal the rows anew between
    two uses."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    path = scratch_path(spark, f"ranges-{uuid.uuid4().hex}")
    with shuffles_dropped(spark):
        ranged.withColumn(_AT, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    placed = spark.read.parquet(path)
    return placed.withColumn(_RANGE, F.shiftright(_AT, _ROW_BITS)).withColumn(_AT, F.col(_AT).bitwiseAND((1 << _ROW_BITS) - 1))


def _offsets(ranges: DataFrame, sums: list[str]) -> DataFrame:
    """One row per range: the sums over all ranges before it."""
    before = W.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    return ranges.select(_RANGE, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in sums])


def with_position(df: DataFrame, order: list[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """`df` with its 0-based position in `order` over all rows.

    End `order` with a unique key: equal rows go to one range, and which of
    them comes first is fixed by the written ranges alone."""
    placed = _placed(df, order, partitions)
    counts = placed.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n"))
    joined = placed.join(F.broadcast(_offsets(counts, ["n"])), _RANGE)  # a row per range
    return joined.select(*df.columns, (F.col("__before_n") + F.col(_AT)).alias(name))


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """`df` with, for each (new column, value column) of `sums`, the sum of the
    value over this row and all before it in `order`.

    Rows of one range are summed in one task; `order` has to tell rows apart,
    so aggregate by the order key first."""
    placed = _placed(df, order, partitions)
    totals = placed.groupBy(_RANGE).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    within = W.partitionBy(_RANGE).orderBy(_AT).rowsBetween(W.unboundedPreceding, 0)
    inside = placed.select("*", *[F.sum(v).over(within).alias(f"__in_{n}") for n, v in sums.items()])
    joined = inside.join(F.broadcast(_offsets(totals, list(sums))), _RANGE)  # a row per range
    return joined.select(*df.columns, *[(F.coalesce(f"__before_{n}", F.lit(0)) + F.coalesce(f"__in_{n}", F.lit(0))).alias(n) for n in sums])

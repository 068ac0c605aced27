"""Intermediate tables written once per application to the shared checkpoint
folder (``spark.checkpoint.dir``).

Reused, expensive-to-derive tables (daily demand, the churn feature table)
are written as parquet and read back: later jobs get a short lineage, a lost
executor recomputes from the written files rather than from the raw facts,
and nothing is held only in executor memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.session import scratch_path, shuffles_dropped

_TABLES: dict = {}


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def source_mark(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, length and modification time of the source files: it changes
    when a table is rewritten."""
    fs, top = _folder(spark, sf_dir)
    out = []
    for entry in fs.listStatus(top):
        files = fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(sorted(out))


def materialized(spark: SparkSession, key: str, sf_dir: str, build: Callable[[], DataFrame],
                 partition_by: list[str] | None = None) -> DataFrame:
    """``build()`` written once per application, key and state of the source
    files in ``sf_dir``, then read back; a rewritten source is built anew and
    replaces the stored table. ``partition_by`` columns become folders, which
    reads prune."""
    k = (spark.sparkContext.applicationId, key, sf_dir)
    mark = source_mark(spark, sf_dir)
    if k not in _TABLES or _TABLES[k][0] != mark:
        path = scratch_path(spark, f"{key}-{uuid.uuid4().hex[:8]}")
        with shuffles_dropped(spark):
            build().write.mode("overwrite").option("compression", "zstd").partitionBy(*(partition_by or [])).parquet(path)
        old = _TABLES.pop(k, None)
        _TABLES[k] = (mark, path)
        if old:
            _drop(spark, old[1])
    return spark.read.parquet(_TABLES[k][1])


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def drop_materialized(spark: SparkSession) -> int:
    """Delete this application's stored tables; returns how many there were."""
    own = [k for k in _TABLES if k[0] == spark.sparkContext.applicationId]
    for k in own:
        _drop(spark, _TABLES.pop(k)[1])
    return len(own)


def customer_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer dimension (CB), derived from customers and orders once
    per session and stored like the source's ``dim_customers`` table."""
    from halyard.plans import adapters as ad

    return materialized(spark, "customer_base", sf_dir, lambda: ad.customer_base(spark, sf_dir))


def daily_demand_fact(spark: SparkSession, sf_dir: str, series: str = "segment") -> DataFrame:
    """The daily-demand fact (DD), one row per series and day, stored like
    the source's ``fact_daily_demand`` table."""
    from halyard.plans import adapters as ad

    return materialized(spark, f"daily_demand-{series}", sf_dir, lambda: ad.daily_demand(spark, sf_dir, series))

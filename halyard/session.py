"""Session construction and cluster-safe scratch locations.

Every job in the package takes a ``SparkSession`` from the caller; this module
only offers a builder with sane defaults for local runs and the one place that
decides where lineage-cutting checkpoints go.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults that matter at scale: AQE re-plans joins/partition counts at
# runtime, skew-join splits hot partitions, UTC keeps timestamps comparable
# with the SQL oracles, Arrow carries the few pandas hops.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def get_session(
    app: str = "halyard",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) a session with the package defaults applied.

    On a cluster, pass ``master=None`` so spark-submit decides; the
    shuffle-partition count should then be sized to the data (AQE coalesces
    small partitions anyway).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and intermediate tables: the one
    given to ``setCheckpointDir``, else ``spark.checkpoint.dir``.

    Only a local master gets a folder of its own where neither is set. On a
    cluster a machine-local folder would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path:
        return path
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="halyard-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


#: Spark 4.1's switch that deletes a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when each query ends. For steps
    that write their rows: nothing reads the shuffles again, but by default
    they stay until the driver happens to collect garbage, so a job of many
    steps holds the shuffles of all."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    functions pickled by module reference resolve on every executor even when
    the driver alone has the repository on its path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-ship-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, in any store that Spark writes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread_partitions(df, min_partitions: int | None = None):
    """Round-robin ``df`` over at least ``min_partitions`` tasks (default:
    the session's parallelism) when its scan yields fewer.

    For CPU-heavy per-row work (tokenising long texts) a single-row-group
    file would otherwise be processed by one task. On a cluster, input
    splits already exceed the parallelism and this is a no-op.
    """
    try:
        spark = df.sparkSession
        target = min_partitions or spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < target:
            return df.repartition(target)
    except Exception:  # no RDD access (Spark Connect): leave the layout to AQE
        pass
    return df

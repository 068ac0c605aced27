"""What the training-data operators share: reading a table, shipping the
package to the workers and cutting lineage in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.session import checkpoint_dir, drop_path, ship_package, shuffles_dropped

#: Rows that one Arrow batch carries to a Python worker. Texts may be long, so batches are short.
BATCH_ROWS = "2000"
#: Parts of a group in which a bounded sample is ranked first.
SPREAD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(df: DataFrame) -> DataFrame:
    """`df`, after its session can run this package's functions on workers."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later jobs, and a lost
    executor, read the written rows."""
    checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: a cut for
    wide or text rows, which Parquet keeps smaller than a checkpoint does."""
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored rows that no later step reads. Frames derived
    from such rows have no files of their own."""
    for df in frames:
        path = vars(df).get("stored_path")
        if path:
            drop_path(df.sparkSession, path)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a row number. It holds within one job only: files are split by the
    cores at hand, so a job after a lost or added executor numbers anew. Write
    the rows with it, or use `numbered`."""
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` with a row number, written once: every later job reads the same
    numbers from the files, whatever executors it has. They separate rows that
    repeat a document id."""
    return stored(with_row_id(df, name))


def lowest_hashes(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k rows of each group with the lowest hash of `key`. They are taken
    within `SPREAD` parts of a group first, so that no task ranks more of a
    large group than k rows a part."""
    part = F.pmod(F.xxhash64(F.lit(1), key), F.lit(SPREAD))
    order = (F.xxhash64(key), key)
    first = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    last = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    spread = rows.withColumn("__part", part).withColumn("__k", first).filter(F.col("__k") <= k)
    return spread.withColumn("__k", last).filter(F.col("__k") <= k).select(*rows.columns)


def fraction(crc_mod: int, key: str):
    """crc32 of a key's decimal text, modulo `crc_mod`: the split rule of the
    learned operators."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % crc_mod

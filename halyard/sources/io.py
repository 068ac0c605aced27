"""Sources and sinks: declared-schema CSV, parquet tables, JSON documents and
model artifacts. Nothing here goes through the driver: every write is a
distributed Spark write, every read a distributed scan.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw customer export: every column is text, typed later by the cleaning ops.
RAW_CUSTOMER_COLUMNS = (
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "Contract", "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
)
RAW_CUSTOMER_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_CUSTOMER_COLUMNS])

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("gender", T.StringType(), True),
    T.StructField("senior_citizen", T.BooleanType(), True),
    T.StructField("partner", T.BooleanType(), True),
    T.StructField("dependents", T.BooleanType(), True),
    T.StructField("tenure_months", T.IntegerType(), True),
    T.StructField("subscription_type", T.StringType(), True),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("monthly_charges", T.DoubleType(), True),
    T.StructField("total_charges", T.DoubleType(), True),
    T.StructField("churn_status", T.BooleanType(), True),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A2: full-table scan (columns and filters are pruned by Catalyst)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 64, fetch_size: int = 10_000) -> DataFrame:
    """A2 (database variant): a partitioned JDBC scan. With a numeric
    ``partition_column`` and bounds, Spark issues ``num_partitions``
    parallel range queries instead of one single-connection read; filters
    and projections are pushed into the SQL. (Needs the driver jar on the
    classpath; untested here because no database may run in this sandbox.)"""
    opts = dict(properties or {})
    opts["fetchsize"] = str(fetch_size)
    if partition_column is not None:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=opts)
    return spark.read.jdbc(url, table, properties=opts)


def read_customers_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_CUSTOMER_SCHEMA) -> DataFrame:
    """A1: CSV scan with a declared schema (never inferred)."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns in order, cast to declared types; columns
    missing from ``df`` become typed nulls."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def overwrite_table(df: DataFrame, path: str, schema: T.StructType | None = None,
                    partition_by: list[str] | None = None) -> None:
    """A3: truncate-and-load keeping the declared schema; creates if missing.

    ``partition_by`` lets big fact tables be laid out for partition pruning.
    """
    out = conform(df, schema) if schema is not None else df
    w = out.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A4: distributed CSV export with a header line per part file. Values
    are written verbatim (Spark trims whitespace by default, which would
    turn a blank ' ' total into an empty field)."""
    (df.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A5: parquet artifact (scored feedback, timelines)."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json_doc(df: DataFrame, path: str) -> None:
    """Metrics / stats documents as JSON lines (nested structs kept)."""
    df.write.mode("overwrite").json(path)


def read_json_doc(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def save_model_artifact(model, path: str, metadata: dict) -> None:
    """Persist a fitted ``PipelineModel`` plus a JSON side document with
    the feature list, threshold, metrics and business parameters."""
    model.write().overwrite().save(os.path.join(path, "model"))
    spark = SparkSession.getActiveSession()
    doc = spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "meta string")
    doc.coalesce(1).write.mode("overwrite").text(os.path.join(path, "metadata"))


def load_model_artifact(spark: SparkSession, path: str):
    """Load the model and its metadata document."""
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(os.path.join(path, "model"))
    meta_row = spark.read.text(os.path.join(path, "metadata")).first()
    return model, json.loads(meta_row[0])

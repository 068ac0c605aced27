"""B7 for text columns that no rule names: a fitted dictionary of codes.

The dictionary is a table (column, value, code) built by aggregation, so a
column may have any number of values; stored once, it gives training, batch
and stream the same codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.operators.ranking import with_position

#: The code of a null and of a value that the dictionary doesn't hold.
UNSEEN = -1


def text_columns(df: DataFrame, named: tuple[str, ...] = ()) -> list[str]:
    """The text columns of `df` besides the `named` ones."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in named]


def fit_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): every column's values numbered from 0 in the
    order of their bytes. Nulls have no entry. A column's values are counted
    per partition first and ranked by ranges, in no single task."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("x")
    values = df.select(pairs).select("x.*").filter(F.col("value").isNotNull()).distinct()
    placed = with_position(values, [F.col("column"), F.col("value")], "__position")
    first = placed.groupBy("column").agg(F.min("__position").alias("__first"))  # a row per column
    return placed.join(F.broadcast(first), "column").select("column", "value", (F.col("__position") - F.col("__first")).alias("code"))


def encode_labels(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """`df`, batch or stream, with `<column>_code` (long) for each column;
    `UNSEEN` for nulls and unknown values. Rows and other columns stay. The
    dictionary is joined without a hint, as it may be as large as the data."""
    out = df
    for k, c in enumerate(columns):
        key, code = f"__value_{k}", f"{c}_code"
        own = codes.filter(F.col("column") == c).select(F.col("value").alias(key), F.col("code").alias(f"__code_{k}"))
        joined = out.join(own, F.col(f"`{c}`") == F.col(key), "left")
        out = joined.withColumn(code, F.coalesce(f"__code_{k}", F.lit(UNSEEN).cast("long"))).drop(key, f"__code_{k}")
    return out

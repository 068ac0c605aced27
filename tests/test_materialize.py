"""Stored tables follow their source and can be dropped."""

from pyspark.sql import functions as F

from halyard.plans.materialize import _TABLES, drop_materialized, materialized


def test_a_rewritten_source_gives_new_rows(spark, tmp_path):
    source = f"{tmp_path}/source"
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(f"{source}/t.parquet").select((F.col("id") * 2).alias("x"))

    spark.range(5).write.parquet(f"{source}/t.parquet")
    assert materialized(spark, "doubled", source, build).count() == 5
    assert materialized(spark, "doubled", source, build).count() == 5 and len(calls) == 1
    spark.range(50).write.mode("overwrite").parquet(f"{source}/t.parquet")
    assert materialized(spark, "doubled", source, build).count() == 50 and len(calls) == 2


def test_stored_tables_can_be_dropped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    kept = dict(_TABLES)
    _TABLES.clear()
    try:
        materialized(spark, "three", str(tmp_path), lambda: spark.range(3))
        assert drop_materialized(spark) == 1 and not _TABLES
    finally:
        _TABLES.update(kept)

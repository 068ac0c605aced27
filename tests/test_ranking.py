import pytest
from pyspark.sql import functions as F

from halyard.operators.ranking import with_position, with_running_sums


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_position_is_the_rank_over_all_rows(spark, partitions):
    df = spark.range(0, 1000, 1, 7).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = [(r["v"], r["id"]) for r in with_position(df, [F.desc("v"), F.asc("id")], partitions=partitions).orderBy("position").collect()]
    assert got == sorted(got, key=lambda p: (-p[0], p[1])) and len(got) == 1000
    placed = with_position(df, [F.asc("v"), F.asc("id")], "p", partitions)
    assert sorted(r["p"] for r in placed.collect()) == list(range(1000))


@pytest.mark.parametrize("partitions", [1, 5, 64])
def test_running_sums(spark, partitions):
    df = spark.range(300).withColumn("v", F.col("id") % 7).withColumn("w", F.when(F.col("id") % 5 > 0, F.col("id")))
    rows = with_running_sums(df, [F.desc("id")], {"sv": "v", "sw": "w"}, partitions).orderBy(F.desc("id")).collect()
    sv = sw = 0
    for r in rows:
        sv, sw = sv + r["v"], sw + (r["w"] or 0)
        assert (r["sv"], r["sw"]) == (sv, sw)


def test_no_rows(spark):
    none = spark.range(0).withColumn("v", F.col("id"))
    assert with_position(none, [F.asc("id")]).count() == 0
    assert with_running_sums(none, [F.asc("id")], {"s": "v"}).count() == 0

"""The least draws of each class against one sort of everything."""

import pytest
from pyspark.sql import functions as F
from stridelog.operators.inject import SEED, _draw, least, sample


@pytest.fixture(scope="module")
def drawn(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 100 < 60, "G1_TARGET").when(F.col("id") % 100 < 99, "BENIGN").when(F.col("id") < 1_000, None).otherwise("CONTROL").alias("fault_class"), F.concat(F.lit("r"), (F.col("id") % 900).cast("string")).alias("run_id"), F.lit("s").alias("source"), (F.col("id") / 900).cast("int").alias("step_index")
    )
    # repeated rows, and a class of which all share their digits
    return rows.unionAll(rows.limit(500)).withColumn("draw", F.when(F.col("fault_class") == "CONTROL", "00ff").otherwise(_draw(SEED)))


ORDER = ["draw", "run_id", "step_index"]


@pytest.mark.parametrize("k", [0, 1, 7, 1_000, 30_000, 100_000])
def test_least_of_each_class(drawn, k):
    want = {}
    for r in sorted((tuple(r) for r in drawn.select("fault_class", *ORDER).where("fault_class IS NOT NULL").collect())):
        want.setdefault(r[0], []).append(r)
    got = least(drawn, "fault_class", "draw", [F.col(c) for c in ORDER], k)
    assert got.columns == drawn.columns
    assert sorted(tuple(r) for r in got.select("fault_class", *ORDER).collect()) == sorted(r for rows in want.values() for r in rows[:k])


def test_caps_of_a_run_and_an_empty_table(spark, drawn):
    rows = drawn.drop("draw").where("fault_class IS NOT NULL").distinct()
    got = sample(rows, per_class=100_000, max_per_run=3).groupBy("fault_class", "run_id").count()
    assert got.agg(F.max("count")).first()[0] == 3 and sample(rows, per_class=50, max_per_run=0).groupBy("fault_class").count().where("count <> 50").count() == 0
    assert sample(rows.where("false")).count() == 0

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skyloom.skew import join_counted


@pytest.mark.parametrize("share", [1, 3, 10_000])
def test_same_rows_as_a_plain_join(spark, share):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 7).when(F.col("id") % 10 != 0, F.col("id") % 50).alias("k"), "id")
    unique = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k IS NULL OR k <> 9")
    got = sorted((r.id, r.top) for r in join_counted(rows, unique, ["k"], "n", share=share).collect())
    tops = {r.k: r.top for r in unique.collect()}
    want = sorted((r.id, tops[r.k]) for r in rows.collect() if r.k in tops)
    assert got == want and len(got) < 1000
    assert join_counted(rows.limit(0), unique.limit(0), ["k"], "n").count() == 0


def test_heavy_keys_are_not_shuffled(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 5 < 2, -1).otherwise(F.col("id")).alias("k"), "id")
    unique = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_counted(rows, unique, ["k"], "n", total=100_000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") >= 2 and plan.count("SortMergeJoin") == 1

"""Plans: what reaches the scan, what is not allowed to appear."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from skyloom.operators import features as fe
from skyloom.operators import sequences as sq
from skyloom.operators import stations as st
from skyloom.plans.catalog import QUERIES
from skyloom.sources.tables import Tables

SF = "/root/testdata/sf0.001"
PYTHON_ALLOWED = ("ml_", "ev_15", "ev_17_ndb")
EAGER = ("pl_08", "src_", "snk_", "str_01", "str_02_sliding_clips_stream", "ml_", "vo_05", "vo_06", "vo_07", "pl_01", "pl_03", "pl_04", "pl_05", "ev_17_ndb", "ev_23")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_pair_of_everything_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if not name.startswith(PYTHON_ALLOWED):
        assert "Python" not in text and "InPandas" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["ag_01_resample_six_hours"](spark, SF))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>", text)


def test_radius_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/customer.parquet").select(
        F.col("c_custkey").alias("stid"), F.col("c_acctbal").alias("latitude"), F.col("c_acctbal").alias("longitude")
    )
    text = plan(st.find_nearest(df, latitude=40.0, longitude=-100.0, n_miles=50, max_stations=5))
    assert "GreaterThanOrEqual(c_acctbal" in text and "TakeOrderedAndProject" in text


def test_windows_are_cut_below_the_key(spark):
    """No window over readings is partitioned by the station alone."""
    t = Tables(spark, SF)
    text = plan(fe.rolling_time(t.obsh, ["stationid"], "datetime", {"s": ("precip", "sum")}))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", text)
    assert windows and all("_slice" in w for w in windows)


def test_top_k_is_limited_before_the_shuffle(spark):
    t = Tables(spark, SF)
    text = plan(sq.top_k_per_class(t.embeddings.select("vec_id", "label"), "label", "vec_id", 5, []))
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Exchange") < text.index("Partial")

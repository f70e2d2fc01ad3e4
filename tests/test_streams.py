"""Streams give what the batch form gives for the periods that are final."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyloom.operators import resample as rs
from skyloom.streaming import streams as sm

OPS = {"x": ["sum", "count", "n_unique", "median", "first", "last"], "word": ["n_unique"]}


@pytest.fixture(scope="module")
def rows():
    start = datetime(2024, 3, 1)
    made = []
    for i in range(400):
        x = [None, float("nan"), 0.0, -0.0, 1.5][i % 5] if i % 3 == 0 else float(i * 7 % 40)
        made.append((str(i % 3), start + timedelta(minutes=37 * i), x, None if i % 11 == 0 else f"w{i % 4}"))
    made += [("hot", start + timedelta(minutes=i), float(i % 50), "w") for i in range(600)]
    return made


def test_all_operations_equal_the_batch(spark, rows, tmp_path):
    schema = "stationid string, datetime timestamp, x double, word string"
    whole = spark.createDataFrame(rows, schema)
    # one file per three days, read one per batch in this order: the state goes on over the batches
    for k in range(4):
        days = (F.dayofmonth("datetime") > 3 * k) & (F.dayofmonth("datetime") <= 3 * k + 3)
        whole.where(days).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sm.read_stream(spark, str(tmp_path / "in"), whole.schema, maxFilesPerTrigger=1)
    out = sm.run_to_end(sm.resample_stream(stream, "1d", OPS, "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    final = F.col("datetime") + F.expr("INTERVAL 1 DAY") <= whole.agg(F.max("datetime") - F.expr("INTERVAL 1 DAY")).scalar()
    clean = whole.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    want = rs.resample(clean, "1d", {"x": ["median"]}).where(final)
    got = {(r["stationid"], r["datetime"]): r for r in out.collect()}
    medians = {(r["stationid"], r["datetime"]): r["x_median"] for r in want.collect()}
    assert len(got) == len(medians) > 20
    assert all(got[k]["x_median"] == pytest.approx(v, nan_ok=True) if v is not None else got[k]["x_median"] is None for k, v in medians.items())
    rest = rs.resample(whole, "1d", {"x": ["count", "n_unique"], "word": ["n_unique"]}).where(final)
    for r in rest.collect():
        mine = got[r["stationid"], r["datetime"]]
        assert [mine[c] for c in ("x_count", "x_n_unique", "word_n_unique")] == [r[c] for c in ("x_count", "x_n_unique", "word_n_unique")]


def test_unknown_operations_are_errors(spark, rows):
    df = spark.createDataFrame(rows[:5], "stationid string, datetime timestamp, x double, word string")
    with pytest.raises(ValueError, match="unknown aggregation"):
        sm.resample_stream(df, "1d", {"x": ["mode"]})

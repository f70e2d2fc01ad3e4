"""Small frames with known results: station search, files, resampling, lags, rolling features."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions.geo import haversine
from skyloom.operators import features as fe
from skyloom.operators import resample as rs
from skyloom.operators import stations as st
from skyloom.plans import jobs
from skyloom.sources import readers, sinks


def series(spark, parts: dict[str, dict], start="2020-01-01", freq="h"):
    frames = []
    for station, cols in parts.items():
        n = len(next(iter(cols.values())))
        frames.append(pd.DataFrame({"stationid": station, "datetime": pd.date_range(start, periods=n, freq=freq), **cols}))
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))


def test_distance_between_two_cities(spark):
    df = spark.range(1).select(haversine(F.lit(40.7128), F.lit(-74.0060), F.lit(51.5074), F.lit(-0.1278)).alias("d"))
    assert 3400 < df.head()[0] < 3500


def test_quadrants(spark):
    df = spark.createDataFrame([(10, 10), (-10, 10), (10, -10), (-10, -10)], "latitude int, longitude int")
    assert [tuple(r) for r in st.filter_quadrant(df, 0, 0, "NE").collect()] == [(10, 10)]
    south = st.filter_quadrant(df, 0, 0, "S").collect()
    assert len(south) == 2 and all(r.latitude <= 0 for r in south)
    assert st.filter_quadrant(df, 0, 0, "UP").count() == 4


def test_nearest_of_unknown_station_is_empty(spark):
    df = spark.createDataFrame([("1", 10.0, 10.0), ("2", 20.0, 20.0)], "stid string, latitude double, longitude double")
    assert st.find_nearest(df, station_id="999", n_miles=0).count() == 0
    with pytest.raises(ValueError):
        st.find_nearest(df)


def test_nearest_with_radius_zero_is_the_station_itself(spark):
    df = spark.createDataFrame([("A", 30.0, 50.0), ("B", 30.1, 50.1)], "stid string, latitude double, longitude double")
    assert [r.stid for r in st.find_nearest(df, station_id="A", n_miles=0).collect()] == ["A"]
    assert [r.stid for r in st.find_nearest(df, station_id="A", n_miles=20).collect()] == ["A", "B"]


def test_station_columns_are_mapped_and_first_row_wins(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text("ID,LAT,LON,elev,note\nS1,45.0,-90.0,100,\nS1,46.0,-91.0,200,x\n")
    row = readers.load_stations(spark, str(path), {"stid": "ID", "latitude": "LAT", "longitude": "LON"}).collect()
    assert len(row) == 1
    assert (row[0].stid, row[0].latitude, row[0].extra_data) == ("S1", 45.0, {"elev": "100"})


def test_missing_station_column_is_null(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text("stid,latitude\nS1,45.0\n")
    assert readers.load_stations(spark, str(path)).head().longitude is None


def test_files_by_id(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("100_data.csv", "deep/200_data.csv", "300_data.csv", "x100_data.csv", "100_data.txt"):
        (tmp_path / name).write_text("date,hour\n2020-01-01,0\n")
    files = readers.list_observation_files(spark, str(tmp_path), ["100", "200", "999"])
    assert sorted(r.stationid for r in files.collect()) == ["100", "200"]
    assert [r.stationid for r in readers.missing_stations(files, ["100", "200", "999"]).collect()] == ["999"]


def test_daily_mean(spark):
    rows = [("1", "2020-01-01 00:00", 10), ("1", "2020-01-01 01:00", 20), ("1", "2020-01-02 00:00", 30), ("1", "2020-01-03 00:00", 40)]
    df = spark.createDataFrame(rows, "stationid string, datetime string, temp int").withColumn("datetime", F.col("datetime").cast("timestamp"))
    out = rs.resample(df, "1D", {"temp": ["mean"]}).orderBy("datetime").collect()
    assert [r.temp_mean for r in out] == [15, 30, 40]
    with pytest.raises(ValueError):
        rs.resample(df, "1d", {"temp": ["mode"]})


def test_job_from_files(spark, tmp_path):
    (tmp_path / "stations.csv").write_text("stid,latitude,longitude\n72206013889,40.0,-105.0\n")
    data = tmp_path / "data"
    data.mkdir()
    lines = [f"2020-01-0{d},01,72206013889,{9 + d}" for d in range(1, 7)]
    (data / "72206013889_data.csv").write_text("date,hour,stid,air_temp\n" + "\n".join(lines) + "\n")
    settings = {
        "stations_csv": str(tmp_path / "stations.csv"), "weather_dir": str(data), "n_miles": 0, "indep_vars": ["air_temp_mean"],
        "agg_map": {"air_temp": ["mean"]}, "period_freq": "1d", "lookback_days": 1, "years_back": 2, "engine": "polars", "chunk_size": 5,
    }
    (tmp_path / "config.json").write_text(json.dumps(settings))
    config = jobs.load_config(str(tmp_path / "config.json"))
    out = jobs.build_model_frame(spark, config, "72206013889", target_var="air_temp_mean")
    assert out.columns == ["y", "72206013889_air_temp_mean_lag_1"]
    assert [tuple(r) for r in out.collect()] == [(2, 14.0), (2, 13.0), (2, 12.0), (2, 11.0), (2, 10.0)]
    assert jobs.build_model_frame(spark, config, "5", target_var="air_temp_mean") is None
    paths = sinks.write_model_frame(out, str(tmp_path / "out"), "72206013889", "frame", ["parquet", "csv"])
    assert spark.read.parquet(paths[0]).count() == 5


def test_unknown_setting_is_an_error(tmp_path):
    (tmp_path / "c.json").write_text('{"no_such": 1}')
    with pytest.raises(TypeError):
        jobs.load_config(str(tmp_path / "c.json"))


def test_short_series_has_lag_columns_and_no_rows(spark):
    df = series(spark, {"1": {"air_temp": [10, 12, 14]}})
    out = fe.dependent_frame(df, "air_temp", 1, "1h", stations=["1"])
    assert "1_air_temp_lag_1" in out.columns and out.count() == 0


TEMPS = [10, 12, 14, 16, 6, 8, 3, 5, 7, 8, 1, 22] + list(range(24, 47, 2)) + [30, 35, 40, 42, 45, 48, 50, 52, 55, 58, 60, 62, 65, 68, 70, 72, 75, 78, 80, 82, 85, 88, 90, 92]


def test_two_stations_have_own_lag_names(spark):
    both = {"air_temp": TEMPS, "humidity": TEMPS[::-1]}
    df = series(spark, {"72206013889": both, "72502014734": both})
    out = fe.dependent_frame(df, "air_temp", 1, "1h", stations=["72206013889", "72502014734"], indep_vars=["humidity"])
    for name in ("72206013889_air_temp_lag_1", "72206013889_humidity_lag_1", "72502014734_air_temp_lag_1", "72502014734_humidity_lag_1"):
        assert name in out.columns
    assert out.head().y == 92


def test_auxiliary_stations_become_columns(spark):
    cols = {"air_temp": [10, 12, 14, 16] * 12, "humidity": [30, 32, 34, 36] * 12}
    df = series(spark, {"1": cols, "2": cols, "3": cols})
    out = fe.dependent_frame(df, "air_temp", 1, "1h", stations=["1", "2", "3"], indep_vars=["humidity"], aux_stations=["2", "3"], drop_date_stationid=False)
    for name in ("1_air_temp_lag_1", "2_air_temp_lag_1", "2_humidity_lag_1", "3_air_temp_lag_1", "3_humidity_lag_1"):
        assert name in out.columns
    rows = out.collect()
    assert rows and {r.stationid for r in rows} == {"1"}
    assert rows[0]["2_air_temp_lag_1"] == rows[0]["1_air_temp_lag_1"]


def test_rolling_over_two_stations(spark):
    cols = {"precip": [1, 2, 3, 4, 5] * 2, "temp": [10, 12, 14, 16, 18] * 2}
    df = series(spark, {"2": cols, "3": cols})
    out = fe.rolling_history(df, {"precip": ["mean", "min"], "temp": ["max"]}, [1], ["2", "3"]).orderBy("datetime").collect()
    assert len(out) == 10
    assert out[4]["multistations_precip_mean_1d"] == 4.0
    assert out[0]["multistations_precip_mean_1d"] is None
    assert out[4]["multistations_precip_min_1d"] == 4 and out[4]["multistations_temp_max_1d"] == 16


def test_rolling_waits_for_a_full_window(spark):
    df = series(spark, {"2": {"precip": [1, 2, 3, 4, 5]}})
    out = fe.rolling_history(df, {"precip": ["mean"]}, [2], ["2"]).orderBy("datetime").collect()
    assert [r["2_precip_mean_2d"] for r in out] == [None, None, 1.5, 2.5, 3.5]


def test_rolling_delay_of_other_methods(spark):
    df = series(spark, {"2": {"precip": [1, 2, 3, 4, 5]}})
    new = fe.rolling_history(df, {"precip": ["median"]}, [2], ["2"]).orderBy("datetime").collect()
    old = fe.rolling_history(df, {"precip": ["median"]}, [2], ["2"], legacy_double_shift=True).orderBy("datetime").collect()
    assert [r[1] for r in new] == [None, None, 1.5, 2.5, 3.5]
    assert [r[1] for r in old] == [None, None, None, 1.5, 2.5]


def test_rolling_of_nothing_is_empty(spark):
    df = spark.createDataFrame([], "stationid string, datetime timestamp, precip double")
    assert fe.rolling_history(df, {"precip": ["mean"]}, [2], ["2"]).count() == 0
    assert fe.rolling_history(df, {"precip": ["mean"]}, [], ["2"]).count() == 0


def test_output_modes(spark):
    df = series(spark, {"P1": {"target": [10, 20, 30, 40, 50]}})
    aux = series(spark, {"P1": {"aux_val": [1, 2, 3, 4, 5]}})
    args = dict(stations=["P1"], aux_dfs=[aux], drop_date_stationid=False)
    both = fe.dependent_frame(df, "target", 0.1, "1h", aux_output_mode="both", **args)
    only = fe.dependent_frame(df, "target", 0.1, "1h", aux_output_mode="aux", **args)
    assert [c for c in both.columns if "lag" in c] == ["P1_target_lag_1", "P1_target_lag_2", "aux_val_lag_1", "aux_val_lag_2"]
    assert [c for c in only.columns if "lag" in c] == ["aux_val_lag_1", "aux_val_lag_2"]
    assert both.head()["aux_val_lag_1"] == 4


def test_target_bins_newest_first(spark):
    df = series(spark, {"1": {"air_temp": [5, 15, 25, 35, 45]}})
    out = fe.dependent_frame(df, "air_temp", 0.1, "1h", stations=["1"], bins=[0, 20, 40, 60], labels=[0, 1, 2])
    assert [r.y for r in out.collect()] == [2, 1, 1]

"""Neighbour search on the whole globe against all pairs, and the filters around it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.functions.geo import bearing
from skyloom.operators import stations as st


def world(n, seed):
    rng = np.random.default_rng(seed)
    lat = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    lon = rng.uniform(-180, 180, n)
    lat[:40] = rng.uniform(86, 90, 40) * rng.choice([-1, 1], 40)  # around the poles
    lon[40:80] = rng.choice([-180, 179.9, -179.9, 180], 40)  # around the date line
    lat[80:120], lon[80:120] = rng.uniform(50, 51, 40), rng.uniform(10, 11, 40)  # a dense place
    return lat, lon


@pytest.mark.parametrize("km", [30, 400, 2500])
def test_pairs_match_all_pairs(spark, km):
    lat, lon = world(400, km)
    pdf = pd.DataFrame({"stid": [str(i) for i in range(400)], "latitude": lat, "longitude": lon})
    got = {(r.tgt_stid, r.feat_stid) for r in st.station_pairs(spark.createDataFrame(pdf), km).collect()}
    p, q = np.radians(lat), np.radians(lon)
    a = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    d = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
    want = {(str(i), str(j)) for i, j in zip(*np.nonzero(d <= km))}
    border = {(str(i), str(j)) for i, j in zip(*np.nonzero(np.abs(d - km) < 1e-6))}
    assert got - border == want - border


def test_no_pair_is_given_twice(spark):
    lat, lon = world(300, 1)
    pdf = pd.DataFrame({"stid": [str(i) for i in range(300)], "latitude": lat, "longitude": lon})
    pairs = st.station_pairs(spark.createDataFrame(pdf), 3000).select("tgt_stid", "feat_stid")
    assert pairs.count() == pairs.distinct().count()


@pytest.mark.parametrize("lat,lon,miles", [(89.5, 0.0, 300), (0.0, 179.9, 200), (-45.0, -179.5, 800), (50.5, 10.5, 40)])
def test_the_box_never_loses_a_station(spark, lat, lon, miles):
    la, lo = world(400, 7)
    pdf = pd.DataFrame({"stid": [str(i) for i in range(400)], "latitude": la, "longitude": lo})
    df = spark.createDataFrame(pdf)
    near = {r.stid for r in st.find_nearest(df, latitude=lat, longitude=lon, n_miles=miles).collect()}
    everything = st.find_nearest(df, latitude=lat, longitude=lon).where(F.col("distance_miles") <= miles)
    assert near == {r.stid for r in everything.collect()}


def test_sectors_close_at_both_ends_and_wrap_at_north(spark):
    df = spark.createDataFrame([(b,) for b in (0.0, 11.24, 11.25, 33.75, 348.75, 348.74, 359.9)], "b double")
    got = lambda d: [r.b for r in st.filter_compass(df, "b", d).orderBy("b").collect()]
    assert got("N") == [0.0, 11.24, 348.75, 359.9]
    assert got("NNE") == [11.25, 33.75]
    assert len(got("RADIUS")) == len(got("nowhere")) == 7


def test_bearing_to_the_four_winds(spark):
    rows = spark.range(1).select(*[bearing(F.lit(0.0), F.lit(0.0), F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))])
    assert np.allclose(list(rows.head()), [0, 90, 180, 270])


def test_finder_refuses_bad_input(spark):
    df = spark.createDataFrame([("A", 1.0, 1.0)], "stid string, latitude double, longitude double")
    for bad in (dict(stid="B"), dict(stid="A", distance=0), dict()):
        with pytest.raises(ValueError):
            st.find_stations(df, **bad)
    assert st.find_stations(df, stid="A").head().distance == 0.0

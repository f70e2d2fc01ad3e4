"""Neighbour pairs over many tasks, the nearest few without all pairs, and rounding without decimals."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators import stations as st

KIND = "stid string, latitude double, longitude double"


def places(seed, n=400):
    """Scattered stations, a crowded spot, many stations at one place, an id at two places, missing ids and places."""
    rng = random.Random(seed)
    rows = [(str(i), rng.uniform(30, 50), rng.uniform(-10, 20)) for i in range(n)]
    rows += [(f"c{i}", 40 + rng.uniform(0, 1e-4), 5 + rng.uniform(0, 1e-4)) for i in range(100)]
    rows += [(f"p{i}", 45.25, -5.5) for i in range(50)] + [("0", 31.0, 19.0), (None, 45.25, -5.5), ("x", None, 1.0)]
    return rows + rows[:60]


def joined_below(text: str, top: str) -> str:
    """The part of a plan between the first ``top`` and the join that makes the pairs."""
    return text[text.index(top):].split("Join", 1)[0]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [1, 3, 8])
@pytest.mark.parametrize("radius", [0.5, 4.0])
def test_the_nearest_few_do_not_need_all_pairs(spark, radius, k):  # F2
    df = spark.createDataFrame(places(k), KIND)
    capped = lambda near: sorted(
        st.cap_per_target(near, "tgt_stid", [F.round("distance", 6), "feat_stid"], k)
        .select("tgt_stid", "feat_stid", "distance").collect(), key=str)
    everything = st.station_pairs(df, radius, "degree")
    some = st.station_pairs(df, radius, "degree", nearest=k)
    assert capped(some) == capped(everything)
    assert some.count() < everything.count()


def test_the_nearest_grow_with_the_stations(spark):  # F2
    rng = np.random.default_rng(3)
    pairs = []
    for n in (500, 2000):
        rows = [(str(i), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 4, (n, 2)))]
        pairs.append(st.station_pairs(spark.createDataFrame(rows, KIND), 4.0, "degree", nearest=3).count())
    assert pairs[1] < 6 * pairs[0]  # all pairs: 16 times as many


def test_nearest_needs_a_number_and_degrees(spark):  # F2
    df = spark.createDataFrame([("A", 1.0, 1.0)], KIND)
    for bad in (dict(unit="km", nearest=3), dict(unit="degree", nearest=0)):
        with pytest.raises(ValueError):
            st.station_pairs(df, 4.0, **bad)


@pytest.mark.parametrize("unit,radius", [("degree", 0.3), ("degree", 4.0), ("km", 50.0), ("km", 400.0)])
def test_pairs_of_one_small_file_are_made_by_many_tasks(spark, unit, radius):  # F3, F4, F5, F7
    rows = places(9)
    pairs = st.station_pairs(spark.createDataFrame(rows, KIND).coalesce(1), radius, unit)
    assert pairs.rdd.getNumPartitions() >= 8
    known = [r for r in rows if r[1] is not None]
    at = np.array([r[1:] for r in known])
    if unit == "degree":
        near = np.sqrt(((at[:, None] - at) ** 2).sum(axis=2)) < radius
    else:
        p, q = np.radians(at).T
        a = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
        near = 2 * 6371.0 * np.arcsin(np.sqrt(a)) <= radius
    want = sorted(str((known[i][0], known[j][0])) for i, j in zip(*np.nonzero(near)))
    assert sorted(str((r.tgt_stid, r.feat_stid)) for r in pairs.select("tgt_stid", "feat_stid").collect()) == want


def test_pairs_are_ranked_where_they_are_made(spark):  # F7
    df = spark.createDataFrame(places(2), KIND).coalesce(1)
    near = st.add_buckets(st.station_pairs(df, 4.0, "degree"))
    between = joined_below(plan(st.rank_neighbours(near)), "Window")
    assert "Sort" in between and "Exchange" not in between


def test_stations_without_the_metrics_are_in_no_pair(spark):  # F6
    df = spark.createDataFrame(places(4), KIND).coalesce(1)
    metrics = spark.createDataFrame([(r[0], m) for r in places(4)[::3] for m in "AR"] + [("1", "A"), (None, "A")], "stid string, metric string")
    ranked = st.target_neighbour_list(df, metrics, ["A", "R"], 4.0)
    text = plan(ranked)
    between = text[text.index("Window"):]
    assert "LeftSemi" not in between[: re.search(r"Join \[band", between).start()]
    pairs = st.add_buckets(st.station_pairs(df, 4.0, "degree"))
    complete = st.stations_with_all(metrics, "stid", "metric", ["A", "R"]).withColumnRenamed("stid", "feat_stid")
    want = st.rank_neighbours(pairs.join(complete, "feat_stid", "left_semi"))
    columns = ["tgt_stid", "feat_stid", "vect_close_bkt", "bearing_bkt", "rank"]
    assert sorted(map(str, ranked.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


@pytest.mark.parametrize("digits", [5, 6])
def test_rounding_gives_the_same_doubles(spark, digits):  # F4, F5
    rng = random.Random(digits)
    values = [rng.uniform(-400, 400) for _ in range(20_000)] + [0.0, -0.0, -1e-9, 1e-300, 1e13 / 3, float("inf"), float("-inf"), float("nan"), None]
    values += [(k + 0.5) / 10**digits for k in range(-3000, 3000)] + [round(rng.uniform(0, 360), 2) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", digits).alias("a"), geo.rounded("x", digits).alias("b")).collect()
    assert all(repr(r.a) == repr(r.b) for r in rows)

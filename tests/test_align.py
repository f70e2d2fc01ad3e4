"""Alignment of sources by date, against plain Python."""

import random
from itertools import zip_longest

import pytest

from skyloom.operators import resample as rs
from skyloom.slicing import ranged


def plain(sources, width):
    """Per date, the sorted values of each source side by side."""
    dates = {r[0] for rows in sources for r in rows}
    out = []
    for d in dates:
        columns = [sorted((r[1:] for r in rows if r[0] == d), key=lambda v: [(x is not None, x if x is not None else 0) for x in v]) for rows in sources]
        for copy in zip_longest(*columns):
            out.append((d, *[x for i, values in enumerate(copy) for x in (values or (None,) * width[i])]))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [3, 8192])
def test_hot_null_and_repeated_dates(spark, monkeypatch, copies):
    """One date holds 40 % of the rows, a fifth has none, and many rows of both are equal."""
    monkeypatch.setattr(rs, "COPIES", copies)
    rng = random.Random(5)
    date = lambda: rng.choices([7, None, rng.randrange(8, 60)], [4, 2, 4])[0]
    a = [(date(), rng.choice([None, 1.5, 2.5, rng.random()]), rng.choice("xy")) for _ in range(900)]
    b = [(date(), rng.randrange(4)) for _ in range(400)]
    got = rs.align_sources([spark.createDataFrame(a, "d int, x double, y string"), spark.createDataFrame(b, "d int, z int")], "d")
    assert got.columns == ["d", "x", "y", "z"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain([a, b], [2, 1])


def test_hot_date_lies_in_several_ranges(spark):
    df = spark.range(20_000).selectExpr("if(id % 5 < 2, -1, id) AS d", "id AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it joins small ranges up to a size in bytes
    try:
        placed = ranged(df, "d", "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed.where("d = -1").groupBy("_range").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 4000
    numbered = rs._copies(df, "d").where("d = -1")
    assert sorted(r["_copy"] for r in numbered.collect()) == list(range(1, 8001))


def test_empty_table_and_key_alone(spark):
    assert rs._copies(spark.createDataFrame([], "d int, v int"), "d").count() == 0
    assert [r["_copy"] for r in rs._copies(spark.range(2).select("id"), "id").collect()] == [1, 1]


def test_window_never_goes_by_the_date_alone(spark):
    df = spark.range(100).selectExpr("id % 3 AS d", "id AS v")
    windows = [line for line in rs.align_sources([df], "d")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and all("_g#" in line or "_slice0#" in line for line in windows)

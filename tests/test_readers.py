"""Observation files: one layout is parsed where it is read, several are told apart by their headers."""

from __future__ import annotations

from pyspark.sql import types as T

from skyloom.sources import readers

SCHEMA = T.StructType([T.StructField("date", T.StringType()), T.StructField("rain", T.DoubleType())])


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def rows(spark, root, ids=None):
    return sorted(tuple(r) for r in readers.read_observations(spark, str(root), SCHEMA, ids).collect())


def joins(spark, root):
    return "Join" in readers.read_observations(spark, str(root), SCHEMA)._jdf.queryExecution().executedPlan().toString()


def test_one_layout_needs_no_join(spark, tmp_path):
    put(tmp_path, "1_a.csv", "date,rain\nd1,1.5\nd2,\n")
    put(tmp_path / "deep", "2_b.csv", "date,rain\nd1,3\n")
    assert not joins(spark, tmp_path)
    assert rows(spark, tmp_path, ["1", "2"]) == [("d1", 1.5, "1"), ("d1", 3.0, "2"), ("d2", None, "1")] == rows(spark, tmp_path)
    assert rows(spark, tmp_path, ["2"]) == [("d1", 3.0, "2")]


def test_other_orders_columns_and_headers_alone(spark, tmp_path):
    put(tmp_path, "1_a.csv", "date,rain\nd1,1.5\n")
    put(tmp_path, "2_b.csv", "﻿rain,extra,date\n2,x,d2\n")
    put(tmp_path, "3_c.csv", "date\nd3\n")
    put(tmp_path, "4_d.csv", "nothing,here\n")
    put(tmp_path, "5_e.csv", "")
    put(tmp_path, "names.csv", "date,rain\nno,9\n")
    assert joins(spark, tmp_path)
    assert rows(spark, tmp_path) == [("d1", 1.5, "1"), ("d2", 2.0, "2"), ("d3", None, "3")]


def test_rejected_records_of_one_layout(spark, tmp_path):
    put(tmp_path, "7_a.csv", "date,rain\nd1,1\nd2,wet\nd3,1,2\n")
    bad = readers.rejected_records(spark, str(tmp_path), SCHEMA).collect()
    assert sorted((r["stationid"], r["line"]) for r in bad) == [("7", "d2,wet"), ("7", "d3,1,2")]


def test_headers_only_and_no_files(spark, tmp_path):
    put(tmp_path, "names.txt", "x")
    assert rows(spark, tmp_path) == []
    put(tmp_path, "1_a.csv", "date,rain\n")
    assert rows(spark, tmp_path) == []

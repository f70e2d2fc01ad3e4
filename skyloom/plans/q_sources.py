"""Checked queries: files written from the given tables, read back through the readers; sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import stations as st
from skyloom.plans.q_features import rounded
from skyloom.registry import query
from skyloom.session import scratch_path
from skyloom.sources import readers, sinks
from skyloom.sources.tables import OBS, PRED, STN


def stored_csv(df, name, **options):
    path = scratch_path(df.sparkSession, name)
    df.write.options(header=True, **options).csv(path)
    return path


def station_files(t):
    """Event readings as one set of CSV files per station."""
    rows = t.events.select(
        F.concat(F.lit("10"), (F.col("user_id") % 5).cast("string")).alias("stationid"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH").alias("hour"), F.col("value").alias("precip"), (F.col("event_id") % 30).cast("double").alias("temp"), "event_id",
    )
    return sinks.write_station_files(rows, scratch_path(t.spark, "stations"), "stationid")


OBS_SCHEMA = "date string, hour string, precip double, temp double, event_id long"


def obs_schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(OBS_SCHEMA)


@query("src_01_load_stations", f"""WITH {STN} SELECT stid, latitude, longitude, s_name AS name, CASE WHEN s_nationkey % 4 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM stations""")
def load_stations(t):
    s = t.stations
    rows = s.select(F.col("stid").alias("ID"), F.col("latitude").alias("LAT"), F.col("longitude").alias("LON"), "s_name", F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey")).alias("nation"))
    path = stored_csv(rows.unionByName(rows), "stationlist")  # every station twice
    out = readers.load_stations(t.spark, path, {"stid": "ID", "latitude": "LAT", "longitude": "LON"})
    return out.select("stid", "latitude", "longitude", F.col("extra_data")["s_name"].alias("name"), F.col("extra_data")["nation"].alias("nation"))


@query("src_02_list_observation_files", "SELECT DISTINCT '10' || CAST(user_id % 5 AS VARCHAR) AS stationid, true AS found FROM events WHERE user_id % 5 IN (1, 3) UNION ALL SELECT '999', false")
def list_files(t):
    root = station_files(t)
    files = readers.list_observation_files(t.spark, root, ["101", "103", "999"])
    gone = readers.missing_stations(files, ["101", "103", "999"]).withColumn("found", F.lit(False))
    return files.select("stationid").distinct().withColumn("found", F.lit(True)).union(gone)


def mixed_files(t):
    """Station files in two column orders; every record whose id is a multiple of 97 has a word for its number."""
    rows = t.events.select(
        F.concat(F.lit("10"), (F.col("user_id") % 5).cast("string")).alias("stationid"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.when(F.col("event_id") % 97 == 0, F.lit("none")).otherwise(F.col("value").cast("string")).alias("precip"),
        F.date_format("ts", "HH").alias("hour"), "event_id",
    )
    root = scratch_path(t.spark, "mixed")
    odd = F.col("stationid").isin("101", "103")
    sinks.write_station_files(rows.where(odd), f"{root}/a", "stationid")
    sinks.write_station_files(rows.where(~odd).select("event_id", "precip", "stationid", "hour", "date"), f"{root}/b", "stationid")
    return root


@query("src_03_mixed_layouts", "SELECT '10' || CAST(user_id % 5 AS VARCHAR) AS stationid, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, CASE WHEN event_id % 97 <> 0 THEN value END AS precip, event_id FROM events")
def mixed_layouts(t):
    return readers.read_observations(t.spark, mixed_files(t), obs_schema()).drop("temp")


@query("src_03_rejected_records", "SELECT '10' || CAST(user_id % 5 AS VARCHAR) AS stationid, count(*) AS n FROM events WHERE event_id % 97 = 0 GROUP BY 1")
def rejected(t):
    return readers.rejected_records(t.spark, mixed_files(t), obs_schema()).groupBy("stationid").agg(F.count("*").alias("n"))


@query("src_03_read_observations", "SELECT '10' || CAST(user_id % 5 AS VARCHAR) AS stationid, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, value AS precip, event_id FROM events WHERE user_id % 5 <> 2")
def read_observations(t):
    ids = ["100", "101", "103", "104"]
    return readers.read_observations(t.spark, station_files(t), obs_schema(), ids).drop("temp")


@query("src_04_ensure_datetime", "SELECT event_id, date_trunc('hour', ts) AS datetime FROM events")
def ensure_datetime(t):
    rows = readers.read_observations(t.spark, station_files(t), obs_schema())
    return readers.ensure_datetime(rows).select("event_id", "datetime")


@query("src_04_ensure_datetime_fractional", "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_minutes((event_id % 48) * 30) AS datetime FROM events")
def ensure_fractional(t):
    rows = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), ((F.col("event_id") % 48) / 2).cast("string").alias("hour"))
    return readers.ensure_datetime(rows, fractional_hours=True).select("event_id", "datetime")


@query("src_05_load_tabular", "SELECT CASE WHEN event_id % 6 = 0 THEN 0 ELSE value END AS value, user_id, event_type, (SELECT count(DISTINCT event_type) FROM events) AS n_out FROM events")
def load_tabular(t):
    path = scratch_path(t.spark, "tabular") + ".parquet"
    t.events.select(F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value"), "user_id", "event_type").write.parquet(path)
    df, n = readers.load_tabular(t.spark, path, "event_type")
    return df.withColumn("n_out", F.lit(n).cast("long"))


@query("src_06_read_station_years", "SELECT CAST(o_custkey % 5 AS VARCHAR) AS station, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 5 IN (1, 4) AND year(o_orderdate) BETWEEN 1995 AND 1997")
def station_years(t):
    rows = t.orders.select((F.col("o_custkey") % 5).alias("station_id"), F.year("o_orderdate").alias("yr"), "o_orderkey", "o_totalprice")
    root = sinks.write_station_files(rows, scratch_path(t.spark, "years"), "station_id", "yr")
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("o_orderkey long, o_totalprice double")
    return readers.read_station_years(t.spark, root, schema, ["1", "4"], [1995, 1996, 1997])


@query("src_07_drop_blank_records", "SELECT CAST(p_partkey AS VARCHAR) AS k, p_brand FROM part WHERE p_partkey % 7 <> 0")
def drop_blank(t):
    rows = t.part.select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey").cast("string")).otherwise(F.lit("  ")).alias("k"), "p_brand")
    return readers.drop_blank_records(readers.read_delimited(t.spark, stored_csv(rows, "blanks"), "k string, p_brand string", ",", header=True), "k")


@query("src_08_read_delimited", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def read_delimited(t):
    path = scratch_path(t.spark, "tsv")
    t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").write.options(sep="|").csv(path)
    return readers.read_delimited(t.spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", "|")


@query("src_09_read_relative_series", "SELECT 'PRD' || lpad(CAST(event_id % 400 AS VARCHAR), 6, '0') || 'H' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') AS var_name, value, TIMESTAMP '2024-02-01' - to_days(CAST(event_id % 400 AS INTEGER)) + to_hours(event_id % 24) AS datetime FROM events")
def relative_series(t):
    from skyloom.plans.q_scalars import named

    rows = named(t).join(t.events.select("event_id", "value"), "event_id").withColumn("ref_date", F.when(F.col("event_id") == 0, "2024-02-01"))
    path = stored_csv(rows.drop("event_id"), "relative")
    return readers.read_relative_series(t.spark, path, "var_name string, value double, ref_date string")


@query("src_10_read_lines", "SELECT line, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents) GROUP BY 1")
def read_lines(t):
    path = scratch_path(t.spark, "lines")
    t.documents.select("text").write.text(path)
    return readers.read_lines(t.spark, path).groupBy("line").agg(F.count("*").alias("n"))


# --- sinks ---------------------------------------------------------------------------------------------------------
@query("snk_01_write_model_frame", f"WITH {OBS} SELECT stationid, count(*) AS n, round(sum(precip), 4) AS total FROM obs GROUP BY 1")
def write_model_frame(t):
    paths = sinks.write_model_frame(t.obs, scratch_path(t.spark, "frame"), "all", "obs", ["parquet", "csv"])
    csv = t.spark.read.schema("stationid string, datetime timestamp, precip double, event_id long").option("header", True).csv(paths[1])
    both = t.spark.read.parquet(paths[0]).join(csv.select("event_id"), "event_id")
    return both.groupBy("stationid").agg(F.count("*").alias("n"), F.round(F.sum("precip"), 4).alias("total"))


@query("snk_02_write_results", f"WITH {PRED} SELECT id, actual, predicted FROM pred")
def write_results(t):
    path = sinks.write_results(t.pred.select("id", "actual", "predicted"), scratch_path(t.spark, "results"), "test_results")
    return t.spark.read.parquet(path)


@query("snk_03_write_splits", "SELECT doc_id, lang, CASE WHEN doc_id % 10 + 1 = 9 THEN 'val' WHEN doc_id % 10 + 1 = 10 THEN 'test' ELSE 'train' END AS split FROM documents")
def write_splits(t):
    from skyloom.operators.splits import split_fold

    df = split_fold(t.documents.select("doc_id", "lang", (F.col("doc_id") % 10 + 1).alias("fold")), "fold").drop("fold")
    return t.spark.read.parquet(sinks.write_splits(df, scratch_path(t.spark, "splits")))


@query("snk_04_write_station_matches", f"""WITH {STN} SELECT stid, latitude, longitude FROM stations""")
def write_matches(t):
    found = st.find_stations(t.stations, latitude=40.0, longitude=-100.0, distance=12000)
    path = sinks.write_station_matches(found, scratch_path(t.spark, "matches"))
    return readers.read_delimited(t.spark, path, "stid string, latitude double, longitude double, distance double, bearing double", ",", header=True).drop("distance", "bearing")

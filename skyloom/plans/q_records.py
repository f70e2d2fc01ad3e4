"""Checked queries: decoding and cleaning of raw records."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.calendar import encode_relative
from skyloom.operators import records as rc
from skyloom.plans.q_features import rounded
from skyloom.registry import query
from skyloom.sources.tables import RAWREC

METRICS = ["AA1", "AA2", "RH1", "RH2", "RH3", "TMP", "SLP", "WND", "CIG"]
LONG = f"""{RAWREC}, long AS ({' UNION ALL '.join(f"SELECT STATION, DATE, '{m}' AS METRIC, {m} AS VALUE FROM rawrec WHERE {m} IS NOT NULL" for m in METRICS)})"""


def long(t):
    return rc.melt_metrics(t.rawrec, ["STATION", "DATE"], METRICS)


def field(start, length, kind="text", v="VALUE"):
    text = f"CASE WHEN length({v}) > 0 THEN substr({v}, {start}, {length}) END"
    return f"CAST({text} AS INTEGER)" if kind == "int" else text


def decode_sql(layout, metric):
    cols = [f"{field(s, n, k)} AS {name}" for name, s, n, k in rc.LAYOUTS[layout]]
    cols += [f"{rc.SCALES[name]} AS {name}_scale" for name, *_ in rc.LAYOUTS[layout] if name in rc.SCALES]
    return f"WITH {LONG} SELECT STATION, DATE, METRIC, VALUE, {', '.join(cols)} FROM long WHERE METRIC IN ({metric})"


@query("pf_01_decode_precip", decode_sql("precip", "'AA1', 'AA2'"))
def decode_precip(t):
    return rc.decode_precip(long(t).where("METRIC IN ('AA1', 'AA2')"))


@query("pf_02_decode_humidity", decode_sql("humidity", "'RH1', 'RH2', 'RH3'"))
def decode_humidity(t):
    return rc.decode_humidity(long(t).where("METRIC LIKE 'RH%'"))


@query("pf_03_decode_temperature", decode_sql("temperature", "'TMP'"))
def decode_temperature(t):
    return rc.decode_temperature(long(t).where("METRIC = 'TMP'"))


@query("pf_04_decode_pressure", decode_sql("pressure", "'SLP'"))
def decode_pressure(t):
    return rc.decode_pressure(long(t).where("METRIC = 'SLP'"))


@query("pf_05_decode_wind", decode_sql("wind", "'WND'"))
def decode_wind(t):
    return rc.decode_wind(long(t).where("METRIC = 'WND'"))


@query("pf_06_decode_ceiling", decode_sql("ceiling", "'CIG'"))
def decode_ceiling(t):
    return rc.decode_ceiling(long(t).where("METRIC = 'CIG'"))


@query("pf_07_flag_empty_value", f"WITH {LONG} SELECT *, length(VALUE) = 0 AS is_empty FROM long")
def flag_empty(t):
    return rc.flag_empty_value(long(t))


@query("pf_08_drop_metadata", "SELECT o_orderkey, o_orderdate FROM orders")
def drop_metadata(t):
    wide = t.orders.select("o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("SOURCE"), F.col("o_totalprice").alias("ELEVATION"), F.col("o_orderpriority").alias("NAME"))
    return rc.drop_metadata(wide)


@query("pf_09_keep_quality", f"WITH {LONG} SELECT STATION, DATE, {field(1, 5, 'int')} AS degrees_cels FROM long WHERE METRIC = 'TMP' AND substr(VALUE, 7, 1) IN ('0', '1', '4', '5', '9')")
def keep_quality(t):
    return rc.keep_quality(rc.decode_temperature(long(t).where("METRIC = 'TMP'")), "quality_code", rc.GOOD_DEPTH_OR_TEMP).select("STATION", "DATE", "degrees_cels")


@query("pf_09_null_quality", f"WITH {LONG} SELECT STATION, DATE, METRIC, CASE WHEN substr(VALUE, 13, 1) IN ('0', '1', '4', '5') THEN {field(7, 3, 'int')} END AS rh_pct FROM long WHERE METRIC LIKE 'RH%'")
def null_quality(t):
    return rc.keep_quality(rc.decode_humidity(long(t).where("METRIC LIKE 'RH%'")), "quality_code", rc.GOOD_HUMIDITY, "null", "rh_pct").select("STATION", "DATE", "METRIC", "rh_pct")


@query("pf_10_drop_sentinels", f"WITH {LONG} SELECT STATION, DATE, {field(1, 5, 'int')} AS degrees_cels FROM long WHERE METRIC = 'TMP' AND substr(VALUE, 1, 5) <> '+9999'")
def drop_sentinels(t):
    return rc.drop_sentinels(rc.decode_temperature(long(t).where("METRIC = 'TMP'")), "degrees_cels", sentinels=[9999]).select("STATION", "DATE", "degrees_cels")


@query("pf_11_apply_scale", f"WITH {LONG} SELECT STATION, DATE, {field(1, 5, 'int')} / 10 AS hpa FROM long WHERE METRIC = 'SLP'")
def apply_scale(t):
    return rc.apply_scale(rc.decode_pressure(long(t).where("METRIC = 'SLP'")), "hectopascals", "hectopascals_scale", "hpa").select("STATION", "DATE", "hpa")


@query("pf_12_keep_period", f"WITH {LONG} SELECT STATION, DATE, METRIC, VALUE FROM long WHERE METRIC LIKE 'AA%' AND substr(VALUE, 1, 2) = '01'")
def keep_period(t):
    return rc.keep_period(rc.decode_precip(long(t).where("METRIC LIKE 'AA%'"))).select("STATION", "DATE", "METRIC", "VALUE")


@query("pf_13_add_day_hour", f"WITH {LONG} SELECT STATION, METRIC, CAST(DATE AS DATE) AS Date_YYYYMMDD, strftime(DATE, '%H') AS HOUR FROM long")
def day_hour(t):
    return rc.add_day_hour(long(t)).select("STATION", "METRIC", "Date_YYYYMMDD", "HOUR")


@query("pf_20_add_country_state", """SELECT s_suppkey, n AS "NAME", right(n, 2) AS "COUNTRY", CASE WHEN right(n, 2) = 'US' THEN left(right(n, 5), 2) ELSE '-' END AS "US_State"
FROM (SELECT s_suppkey, s_name || CASE WHEN s_nationkey % 3 = 0 THEN ', TX US' ELSE ', FR' END AS n FROM supplier)""")
def country_state(t):
    tail = F.when(F.col("s_nationkey") % 3 == 0, F.lit(", TX US")).otherwise(F.lit(", FR"))
    return rc.add_country_state(t.supplier.select("s_suppkey", F.concat("s_name", tail).alias("NAME")))


@query("set_05_melt_metrics", f"WITH {LONG} SELECT * FROM long")
def melt(t):
    return long(t)


@query("wn_09_first_of_duplicates", f"""WITH {LONG} SELECT STATION, CAST(DATE AS DATE) AS Date_YYYYMMDD, strftime(DATE, '%H') AS HOUR, METRIC, VALUE, min(DATE) AS DATE
FROM long WHERE METRIC LIKE 'AA%' GROUP BY 1, 2, 3, 4, 5""")
def dupes(t):
    return rc.first_of_duplicates(rc.add_day_hour(long(t).where("METRIC LIKE 'AA%'")), ["STATION", "Date_YYYYMMDD", "HOUR", "METRIC", "VALUE"], "DATE")


PRECIP = f"""{LONG}, one AS (SELECT STATION, CAST(DATE AS DATE) AS d, strftime(DATE, '%H') AS h, METRIC, VALUE, min(DATE) AS DATE FROM long
  WHERE METRIC IN ('AA1', 'AA2', 'AA3') AND substr(VALUE, 1, 2) = '01' GROUP BY 1, 2, 3, 4, 5),
 good AS (SELECT STATION, d, h, CAST(substr(VALUE, 4, 4) AS INTEGER) / 10.0 AS mm FROM one WHERE substr(VALUE, 11, 1) IN ('0', '1', '4', '5', '9')
  AND CAST(substr(VALUE, 4, 4) AS INTEGER) < 9999),
 s AS (SELECT STATION, d, h, '01' AS p, sum(CAST(mm AS DOUBLE)) AS mm FROM good GROUP BY 1, 2, 3),
 g AS (SELECT STATION, unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS hr FROM one GROUP BY 1),
 precip AS (SELECT g.STATION, CAST(hr AS DATE) AS Date_YYYYMMDD, strftime(hr, '%H') AS HOUR, p AS period_hrs, mm AS precip_depth_sum_mm
  FROM g LEFT JOIN s ON s.STATION = g.STATION AND s.d = CAST(hr AS DATE) AND s.h = strftime(hr, '%H'))"""
TEMP = f"""{LONG}, temp AS (SELECT STATION, Date_YYYYMMDD, HOUR, avg(v) AS air_temp_degrees_cels, '01' AS period_hrs FROM (SELECT DISTINCT STATION,
  CAST(DATE AS DATE) AS Date_YYYYMMDD, strftime(DATE, '%H') AS HOUR, CASE WHEN substr(VALUE, 7, 1) IN ('0', '1', '4', '5', '9') AND substr(VALUE, 1, 5) <> '+9999'
  THEN CAST(substr(VALUE, 1, 5) AS INTEGER) / CAST(10 AS DOUBLE) END AS v FROM long WHERE METRIC = 'TMP') GROUP BY 1, 2, 3)"""
HUM = f"""{LONG}, hum AS (SELECT STATION, CAST(DATE AS DATE) AS Date_YYYYMMDD, strftime(DATE, '%H') AS HOUR,
  {', '.join(f"min(CASE WHEN METRIC = '{m}' AND substr(VALUE, 13, 1) IN ('0', '1', '4', '5') THEN CAST(substr(VALUE, 7, 3) AS DOUBLE) END) AS {n}" for m, n in rc.HUMIDITY_SLOTS.items())},
  '24' AS period_hrs FROM long WHERE METRIC LIKE 'RH%' GROUP BY STATION, DATE)"""


@query("ag_03_hourly_precip", f"WITH {PRECIP} SELECT STATION, Date_YYYYMMDD, HOUR, period_hrs, round(precip_depth_sum_mm, 6) AS precip_depth_sum_mm FROM precip")
def hourly_precip(t):
    return rounded(rc.hourly_precip(long(t)))


@query("ag_04_hourly_temperature", f"WITH {TEMP} SELECT STATION, Date_YYYYMMDD, HOUR, round(air_temp_degrees_cels, 6) AS air_temp_degrees_cels, period_hrs FROM temp")
def hourly_temperature(t):
    return rounded(rc.hourly_temperature(long(t)))


@query("ag_06_daily_humidity", f"WITH {HUM} SELECT * FROM hum")
def daily_humidity(t):
    return rc.daily_humidity(long(t))


CLEAN = [("precip", PRECIP, "precip_depth_sum_mm"), ("temperature", TEMP, "air_temp_degrees_cels"), ("humidity", HUM, "Max_RH_pct")]
for _metric, _sql, _col in CLEAN:
    _table = {"precip": "precip", "temperature": "temp", "humidity": "hum"}[_metric]

    def _clean(t, metric=_metric, col=_col):
        out = rc.clean_station(long(t), metric)
        return out.groupBy("STATION", "Date_YYYYMMDD").agg(
            F.count("*").alias("hours"), F.count(col).alias("known"), F.round(F.sum(col), 5).alias("total")
        )

    query(f"ag_07_clean_{_metric}", f"WITH {_sql} SELECT STATION, Date_YYYYMMDD, count(*) AS hours, count({_col}) AS known, round(sum({_col}), 5) AS total FROM {_table} GROUP BY 1, 2")(_clean)


@query("sc_10_encode_relative", """SELECT event_id, 'PRD' || lpad(CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS VARCHAR), 6, '0') || 'H' || strftime(ts, '%H') AS var_name FROM events""")
def encode(t):
    df = t.events.select("event_id", F.to_date("ts").alias("d"), F.lpad(F.hour("ts").cast("string"), 2, "0").alias("h"))
    return encode_relative(df, "PR", "2024-02-01", "d", "h").select("event_id", "var_name")


@query("set_07_pivot_metrics", f"""WITH {LONG} SELECT STATION, DATE, max(VALUE) FILTER (METRIC = 'TMP') AS "TMP", max(VALUE) FILTER (METRIC = 'SLP') AS "SLP" FROM long GROUP BY 1, 2""")
def pivot(t):
    return rc.pivot_metrics(long(t), ["STATION", "DATE"], ["TMP", "SLP"])


@query("jn_04_decode_lookup", f"""WITH {LONG}, v AS (SELECT VALUE, count(*) AS n FROM long WHERE METRIC = 'AA1' AND VALUE LIKE '01%' GROUP BY 1)
SELECT DATE, METRIC, l.VALUE, v.n FROM long l LEFT JOIN v ON l.VALUE = v.VALUE WHERE METRIC = 'AA1'""")
def lookup(t):
    aa1 = long(t).where("METRIC = 'AA1'").drop("STATION")
    values = aa1.where("VALUE LIKE '01%'").groupBy("VALUE").agg(F.count("*").alias("n"))
    return rc.decode_lookup(aa1, values, ["VALUE"])

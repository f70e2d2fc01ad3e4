"""Checked queries: resampling, lags, rolling features, filters on series."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from skyloom.functions.binning import bin_col
from skyloom.operators import features as fe
from skyloom.operators import resample as rs
from skyloom.operators.quantiles import quantile_bin, quantile_edges
from skyloom.registry import query
from skyloom.slicing import time_slices
from skyloom.sources.tables import OBS, OBSD, OBSH

RAW = lambda c: time_slices(c, "day", "minute")  # noqa: E731  slices for raw readings


def rounded(df, digits=6, only=None):
    todo = [c for c, t in df.dtypes if t == "double" and (only is None or c in only)]
    return df.withColumns({c: F.round(c, digits) for c in todo})


# --- SQL pieces ----------------------------------------------------------------------------------------------------
GRID_H = """grid AS (SELECT stationid, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime
  FROM (SELECT stationid, min(datetime) AS lo, max(datetime) AS hi FROM obsh GROUP BY 1)),
dense AS (SELECT g.stationid, g.datetime, o.precip FROM grid g LEFT JOIN obsh o ON o.stationid = g.stationid AND o.datetime = g.datetime)"""
FILLED_H = f"""{GRID_H}, near AS (SELECT *,
  last_value(precip IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN precip IS NOT NULL THEN datetime END IGNORE NULLS) OVER b AS pt,
  first_value(precip IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN precip IS NOT NULL THEN datetime END IGNORE NULLS) OVER f AS nt
  FROM dense WINDOW b AS (PARTITION BY stationid ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   f AS (PARTITION BY stationid ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT stationid, datetime, CASE WHEN precip IS NOT NULL THEN precip
  WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (epoch_us(datetime) - epoch_us(pt)) / (epoch_us(nt) - epoch_us(pt))
  ELSE coalesce(pv, nv) END AS precip FROM near)"""
DAILY = """daily AS (SELECT stationid, date_trunc('day', datetime) AS datetime, sum(precip) AS precip_sum, avg(precip) AS precip_mean,
  max(temp) AS temp_max FROM obsd GROUP BY 1, 2)"""


def daily(t):
    return rs.resample(t.obsd, "1d", {"precip": ["sum", "mean"], "temp": ["max"]})


@query("pl_00_first_frame", f"""WITH {OBSH}, {FILLED_H},
lagged AS (SELECT *, lag(precip, 1) OVER w AS lag_1, lag(precip, 2) OVER w AS lag_2, row_number() OVER w AS rn FROM filled
  WINDOW w AS (PARTITION BY stationid ORDER BY datetime))
SELECT stationid, datetime, CASE WHEN precip < 5 THEN 0 WHEN precip < 20 THEN 1 WHEN precip < 50 THEN 2 ELSE 3 END AS y,
  round(lag_1, 6) AS lag_1, round(lag_2, 6) AS lag_2 FROM lagged WHERE rn > 2""")
def first_frame(t):
    grid = fe.interpolate_time(fe.densify(t.obsh.drop("n"), "stationid", "datetime", "1h"), "stationid", "datetime", ["precip"])
    lagged = fe.lag_arrays(grid, ["precip"], 2, "1h")
    lag = lambda k: F.round(F.col("precip_lags")[k - 1], 6).alias(f"lag_{k}")
    y = bin_col("precip", [-9999, 5, 20, 50, 99999], [0, 1, 2, 3], closed="left", outside="null")
    return lagged.select("stationid", "datetime", y.alias("y"), lag(1), lag(2)).orderBy(F.desc("datetime"), "stationid")


# --- aggregation ---------------------------------------------------------------------------------------------------
@query("ag_01_resample", f"""WITH {OBS} SELECT stationid, date_trunc('hour', datetime) AS datetime, round(sum(precip), 6) AS precip_sum,
 min(precip) AS precip_min, max(precip) AS precip_max, round(median(precip), 6) AS precip_median, round(avg(precip), 6) AS precip_mean,
 round(stddev_samp(precip), 6) AS precip_std FROM obs GROUP BY 1, 2""")
def resample_all(t):
    return rounded(rs.resample(t.obs, "1h", {"precip": list(rs.DEFAULT_OPS)}))


@query("ag_01_resample_emit_empty", f"""WITH {OBS}, d AS (SELECT stationid, date_trunc('hour', datetime) AS datetime, sum(precip) AS s, avg(precip) AS m
 FROM obs GROUP BY 1, 2), g AS (SELECT stationid, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime FROM d GROUP BY stationid)
SELECT g.stationid, g.datetime, round(coalesce(s, 0), 6) AS precip_sum, round(m, 6) AS precip_mean FROM g LEFT JOIN d USING (stationid, datetime)""")
def resample_empty(t):
    return rounded(rs.resample(t.obs, "1h", {"precip": ["sum", "mean"]}, emit_empty=True))


@query("ag_01_resample_week", f"""WITH {OBS} SELECT stationid, CAST(date_trunc('week', datetime) AS TIMESTAMP) AS datetime, count(precip) AS precip_count,
 round(var_samp(precip), 5) AS precip_var, arg_min(precip, (datetime, precip)) AS precip_first, arg_max(precip, (datetime, precip)) AS precip_last,
 count(DISTINCT precip) AS precip_n_unique FROM obs GROUP BY 1, 2""")
def resample_week(t):
    return rounded(rs.resample(t.obs, "1w", {"precip": ["count", "var", "first", "last", "n_unique"]}), 5)


@query("ag_01_resample_six_hours", f"""WITH {OBS} SELECT stationid, CAST(time_bucket(INTERVAL 6 HOUR, datetime, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS datetime,
 round(sum(precip), 6) AS precip_sum FROM obs GROUP BY 1, 2""")
def resample_six(t):
    return rounded(rs.resample(t.obs, "6h", {"precip": ["sum"]}))


@query("ag_02_aggregate_time", f"""WITH {OBSD} SELECT CAST(date_trunc('month', datetime) AS TIMESTAMP) AS datetime, round(sum(precip), 6) AS precip_sum,
 round(avg(temp), 6) AS temp_mean FROM obsd GROUP BY 1""")
def aggregate_time(t):
    return rounded(rs.aggregate_time(t.obsd, "datetime", "1mo", ["precip", "temp"], ["sum", "mean"]))


@query("ag_05_count_by", f"WITH {OBS} SELECT stationid, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS datetime, count(*) AS n FROM obs GROUP BY 1, 2")
def count_by(t):
    return rs.count_by(t.obs.withColumn("datetime", F.date_trunc("day", "datetime")), ["stationid", "datetime"])


@query("ag_08_consolidate", f"""WITH {OBSH} SELECT datetime, round(coalesce(sum(precip), 0), 6) AS precip FROM obsh GROUP BY 1""")
def consolidate(t):
    return rounded(rs.consolidate(t.obsh, "datetime", ["precip"], "sum"))


@query("ag_09_regional_summary", f"""WITH {OBSH} SELECT datetime, round(avg(precip), 6) AS avg, count(*) FILTER (precip >= 0) AS cnt_ge0,
 count(*) FILTER (precip > 0) AS cnt_gt0 FROM obsh GROUP BY 1""")
def regional_summary(t):
    return rounded(rs.regional_summary(t.obsh, "datetime", "precip"))


@query("ag_10_value_counts", f"""SELECT CASE WHEN l_quantity < 1 THEN NULL WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 30 THEN 2 END AS y, count(*) AS count
 FROM lineitem GROUP BY 1""")
def value_counts(t):
    y = bin_col("l_quantity", [1, 10, 30], [1, 2], closed="left", outside="null")
    return rs.value_counts(t.lineitem.select(y.alias("y")), "y")


@query("ag_11_crosstab", """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "l_linestatus_F", count(*) FILTER (l_linestatus = 'O') AS "l_linestatus_O"
 FROM lineitem GROUP BY 1""")
def crosstab(t):
    return rs.crosstab(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


@query("ag_12_max_by_keys", """SELECT l_suppkey, l_returnflag, max(l_quantity) AS l_quantity, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2""")
def max_by_keys(t):
    return rs.max_by_keys(t.lineitem.select("l_suppkey", "l_returnflag", "l_quantity", "l_shipdate"), ["l_suppkey", "l_returnflag"])


@query("ag_13_series_profile", f"""WITH {OBSH}, n AS (SELECT *, row_number() OVER (PARTITION BY stationid ORDER BY datetime) - 1 AS i FROM obsh)
SELECT stationid, count(*) AS length, count(*) FILTER (precip IS NULL) AS missing, min(i) FILTER (precip IS NOT NULL) AS first_known FROM n GROUP BY 1""")
def series_profile(t):
    return rs.series_profile(t.obsh, ["stationid"], ["datetime"], "precip", time_slices("datetime", "month"))


@query("ag_14_mean_ci", """SELECT event_type, round(avg(value), 6) AS mean, count(value) AS count, round(stddev_samp(value), 6) AS std,
 round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value) / 4.0), 6) AS lo, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value) / 4.0), 6) AS hi
 FROM events GROUP BY 1""")
def mean_ci(t):
    return rounded(rs.mean_ci(t.events, ["event_type"], "value", 4.0))


@query("ag_21_first_by", """SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def first_by(t):
    return rs.first_by(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query("ag_21_distinct", "SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_suppkey", "l_linenumber").distinct()


@query("ag_22_first_row", f"""WITH {OBSD} SELECT stationid, min(datetime) AS datetime FROM obsd GROUP BY 1""")
def first_row(t):
    return rs.first_by(t.obsd.select("stationid", "datetime"), ["stationid"], ["datetime"])


@query("ag_23_histogram", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events),
 b AS (SELECT CAST(least(49, floor((value - lo) / ((hi - lo) / 50))) AS INTEGER) AS bin, count(*) AS c FROM events, s GROUP BY 1)
SELECT CAST(g.i AS INTEGER) AS bin, round(lo + g.i * ((hi - lo) / 50), 6) AS left_edge, coalesce(c, 0) AS count, round(coalesce(c, 0) / (n * ((hi - lo) / 50)), 6) AS height
FROM s, generate_series(0, 49) g(i) LEFT JOIN b ON b.bin = g.i""")
def histogram(t):
    from skyloom.functions.binning import histogram as hist

    return rounded(hist(t.events, "value", 50, True))


@query("sc_06_quantile_edges", """WITH p AS (SELECT value FROM events WHERE value > 0)
SELECT CAST(i AS INTEGER) AS edge_no, round(quantile_cont(value, i / 8.0), 6) AS edge FROM p, generate_series(0, 8) g(i) GROUP BY i""".replace(
    "quantile_cont(value, i / 8.0)", "(CASE i " + " ".join(f"WHEN {i} THEN quantile_cont(value, {i / 8})" for i in range(9)) + " END)"))
def q_edges(t):
    return rounded(quantile_edges(t.events, "value", 8))


@query("sc_06_quantile_bin", """WITH p AS (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS e FROM events WHERE value > 0)
SELECT event_id, CAST(CASE WHEN value = 0 THEN 0 WHEN value < e[1] OR value > e[5] THEN NULL
 ELSE 1 + (value > e[2])::INT + (value > e[3])::INT + (value > e[4])::INT END AS INTEGER) AS bin FROM events, p""")
def q_bin(t):
    return quantile_bin(t.events.select("event_id", "value"), "value", 4).select("event_id", "bin")


# --- series filters ------------------------------------------------------------------------------------------------
@query("pf_14_last_years", f"WITH {OBSD} SELECT * FROM obsd WHERE datetime >= (SELECT max(datetime) - INTERVAL 18 MONTH FROM obsd)")
def last_years(t):
    return fe.last_years(t.obsd, "datetime", 1.5)


@query("pf_15_last_months", f"WITH {OBSD} SELECT * FROM obsd WHERE datetime >= (SELECT max(datetime) - INTERVAL 180 DAY FROM obsd)")
def last_months(t):
    return fe.last_months_30d(t.obsd, "datetime", 6)


@query("pf_16_align_tail", f"""WITH {OBSD}, {DAILY}, e AS (SELECT min(m) AS m FROM (SELECT max(datetime) AS m FROM daily GROUP BY stationid)),
 r AS (SELECT *, row_number() OVER (PARTITION BY stationid ORDER BY datetime DESC) AS rn FROM daily WHERE datetime < (SELECT m FROM e))
SELECT stationid, datetime, precip_sum FROM r WHERE rn <= 100""")
def align_tail(t):
    return fe.align_tail(daily(t).select("stationid", "datetime", "precip_sum"), "stationid", "datetime", 100, time_slices("datetime", "year"))


@query("pf_17_keep_finite", f"WITH {OBSH} SELECT stationid, datetime, round(precip, 6) AS precip FROM obsh WHERE precip IS NOT NULL")
def keep_finite(t):
    return rounded(fe.keep_finite(t.obsh.drop("n"), "precip"))


@query("pf_18_keep_wet_windows", f"""WITH {OBSH}, r AS (SELECT datetime, avg(precip) AS avg FROM obsh GROUP BY 1),
 s AS (SELECT datetime, sum(avg) OVER (ORDER BY datetime ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS rain_sum FROM r)
SELECT datetime, round(rain_sum, 8) AS rain_sum FROM s WHERE rain_sum > 0""")
def wet_windows(t):
    reg = rs.regional_summary(t.obsh, "datetime", "precip").select("datetime", "avg")
    return rounded(fe.keep_wet_windows(fe.wet_flag(reg, "datetime", "avg", 8), "rain_sum").select("datetime", "rain_sum"), 8)


@query("pf_19_binary_target", "SELECT event_id, CASE WHEN value <= 0.5 THEN 0 ELSE 1 END AS y, CASE WHEN value <> 0 THEN 1 ELSE 0 END AS has_rain FROM events")
def binary(t):
    from skyloom.functions.binning import binary_target

    return t.events.select("event_id", binary_target("value", 0.5).alias("y"), (F.col("value") != 0).cast("int").alias("has_rain"))


@query("pf_21_select_output", f"""WITH {OBSD}, {DAILY}, l AS (SELECT stationid, datetime, precip_sum AS y,
  lag(precip_sum) OVER (PARTITION BY stationid ORDER BY datetime) AS own_lag_1, lag(temp_max) OVER (PARTITION BY stationid ORDER BY datetime) AS aux_lag_1 FROM daily)
SELECT stationid, datetime, y, aux_lag_1 FROM l""")
def select_output(t):
    from skyloom.slicing import own_rows, row_frames

    frame, w = row_frames(daily(t), ["stationid"], ["datetime"], time_slices("datetime", "year"), before=1)
    df = own_rows(frame.withColumns({"own_lag_1": F.lag("precip_sum").over(w), "aux_lag_1": F.lag("temp_max").over(w)})).withColumnRenamed("precip_sum", "y")
    return fe.select_output(df, "aux", {"base": ["stationid", "datetime", "y"], "primary": ["own_lag_1"], "aux": ["aux_lag_1"]})


@query("pf_22_drop_keys", f"WITH {OBSD} SELECT precip, temp FROM obsd")
def drop_keys(t):
    names = fe.unique_columns(["precip", "temp", "precip", "stationid", "datetime"])
    return fe.drop_keys(t.obsd.select(*names), ["stationid", "datetime"])


@query("pf_23_rename_positional", f"WITH {OBSD} SELECT stationid AS id, datetime, precip AS rain, temp FROM obsd")
def rename_positional(t):
    return fe.rename_positional(t.obsd, {0: "id", 2: "rain"})


@query("pf_24_target_first", f"WITH {OBSD} SELECT temp, stationid, datetime, precip FROM obsd")
def target_first(t):
    return fe.target_first(t.obsd, "temp")


@query("pf_26_every_kth", """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i % 4 = 0""")
def every_kth(t):
    from skyloom.operators.sequences import every_kth as kth

    return kth(t.seq, ["user_id"], ["ts", "event_id"], 4, RAW("ts")).select("event_id", "user_id")


# --- windows -------------------------------------------------------------------------------------------------------
@query("wn_01_lag_features", f"""WITH {OBSH}, {FILLED_H},
l AS (SELECT *, {', '.join(f'lag(precip, {k}) OVER w AS l{k}' for k in range(1, 25))}, row_number() OVER w AS rn FROM filled WINDOW w AS (PARTITION BY stationid ORDER BY datetime))
SELECT stationid, datetime, round(precip, 6) AS y, {', '.join(f'round(l{k}, 6) AS precip_lag_{k}' for k in range(1, 25))} FROM l WHERE rn > 24""")
def lag_features(t):
    out = fe.lag_features(t.obsh, "precip", lookback_days=1, freq="1h")
    return rounded(out.select("stationid", "datetime", "y", *[F.col("precip_lags")[k - 1].alias(f"precip_lag_{k}") for k in range(1, 25)]))


@query("wn_02_add_lags", f"""WITH {OBSD}, d AS (SELECT datetime, sum(precip) AS precip FROM obsd GROUP BY 1)
SELECT datetime, precip, lag(precip, 1) OVER w AS precip_lag_1, lag(precip, 2) OVER w AS precip_lag_2, lag(precip, 3) OVER w AS precip_lag_3
FROM d WINDOW w AS (ORDER BY datetime)""")
def add_lags(t):
    return fe.add_lags(rs.consolidate(t.obsd, "datetime", ["precip"], "sum"), "datetime", "precip", 3, time_slices("datetime", "year"))


def _roll(fn, w, col):
    frame = f"OVER (PARTITION BY stationid ORDER BY datetime ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({col}) {frame} = {w} THEN {fn}({col}) {frame} END"


@query("wn_03_rolling_history", f"""WITH {OBSD}, {DAILY}, r AS (SELECT datetime, {_roll('avg', 3, 'precip_sum')} AS a, {_roll('sum', 7, 'precip_sum')} AS b,
 {_roll('max', 7, 'temp_max')} AS c FROM daily)
SELECT datetime, round(avg(a), 6) AS aux_precip_sum_mean_3d, round(coalesce(sum(b), 0), 6) AS aux_precip_sum_sum_7d,
 max(c) AS aux_temp_max_max_7d FROM r GROUP BY 1""")
def rolling_history(t):
    out = fe.rolling_history(daily(t), {"precip_sum": ["mean", "sum"], "temp_max": ["max"]}, [3, 7], [], slices=time_slices("datetime", "year"))
    return rounded(out.select("datetime", "aux_precip_sum_mean_3d", "aux_precip_sum_sum_7d", "aux_temp_max_max_7d"))


@query("wn_03b_rolling_other", f"""WITH {OBSD}, {DAILY}, r AS (SELECT datetime, {_roll('stddev_samp', 5, 'precip_sum')} AS a FROM daily)
SELECT datetime, round(stddev_samp(a), 5) AS aux_precip_sum_std_5d FROM r GROUP BY 1""")
def rolling_other(t):
    return rounded(fe.rolling_history(daily(t), {"precip_sum": ["std"]}, [5], [], slices=time_slices("datetime", "year")), 5)


@query("wn_04_rolling_time", f"""WITH {OBSH} SELECT stationid, datetime, round(sum(coalesce(precip, 0)) OVER w, 6) AS rain_24h,
 round(CASE WHEN count(precip) OVER w >= 6 THEN avg(precip) OVER w END, 6) AS mean_24h FROM obsh
 WINDOW w AS (PARTITION BY stationid ORDER BY datetime RANGE BETWEEN INTERVAL '23:59:59.999999' HOUR PRECEDING AND CURRENT ROW)""".replace(
    "INTERVAL '23:59:59.999999' HOUR", "INTERVAL '86399.999999 seconds'"))
def rolling_time(t):
    out = fe.rolling_time(t.obsh, ["stationid"], "datetime", {"rain_24h": ("precip", "sum"), "mean_24h": ("precip", "mean")})
    return rounded(out.drop("precip", "n"))


@query("wn_04_rolling_time_forward", f"""WITH {OBSH} SELECT stationid, datetime, round(sum(coalesce(precip, 0)) OVER w, 6) AS rain_24h FROM obsh
 WINDOW w AS (PARTITION BY stationid ORDER BY datetime RANGE BETWEEN CURRENT ROW AND INTERVAL '86399.999999 seconds' FOLLOWING)""")
def rolling_forward(t):
    out = fe.rolling_time(t.obsh, ["stationid"], "datetime", {"rain_24h": ("precip", "sum")}, direction="forward")
    return rounded(out.drop("precip", "n"))


@query("wn_05_interpolate", f"WITH {OBSH}, {FILLED_H} SELECT stationid, datetime, round(precip, 6) AS precip FROM filled")
def interpolate(t):
    grid = fe.densify(t.obsh.select("stationid", "datetime", "precip"), "stationid", "datetime", "1h")
    return rounded(fe.interpolate_time(grid, "stationid", "datetime", ["precip"]))


@query("wn_06_forward_fill", f"""WITH {OBSH}, {GRID_H} SELECT stationid, datetime, round(last_value(precip IGNORE NULLS) OVER (PARTITION BY stationid ORDER BY datetime
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS precip FROM dense""")
def forward_fill(t):
    grid = fe.densify(t.obsh.select("stationid", "datetime", "precip"), "stationid", "datetime", "1h")
    return rounded(fe.forward_fill(grid, "stationid", "datetime", ["precip"]))


@query("wn_07_lag_matrix", f"""WITH {OBSD}, {DAILY}, m AS (SELECT *, row_number() OVER w AS rn, {', '.join(f'lag(precip_sum, {k}) OVER w AS p{k}, lag(temp_max, {k}) OVER w AS t{k}' for k in range(4))}
 FROM daily WINDOW w AS (PARTITION BY stationid ORDER BY datetime))
SELECT stationid, datetime, {', '.join(f'p{k} AS precip_{k}, t{k} AS temp_{k}' for k in range(4))} FROM m WHERE rn >= 4""")
def lag_matrix(t):
    out = fe.lag_matrix(daily(t), ["stationid"], "datetime", ["precip_sum", "temp_max"], 4, time_slices("datetime", "year"))
    h = F.col("history")
    return out.select("stationid", "datetime", *[h[k]["precip_sum"].alias(f"precip_{k}") for k in range(4)], *[h[k]["temp_max"].alias(f"temp_{k}") for k in range(4)])


@query("wn_08_gap_features", f"""WITH {OBSD}, {DAILY}, m AS (SELECT *, row_number() OVER w AS rn, lag(precip_sum, 4) OVER w AS f1, lag(precip_sum, 5) OVER w AS f2
 FROM daily WINDOW w AS (PARTITION BY stationid ORDER BY datetime))
SELECT stationid, datetime, precip_sum AS y, f1, f2, CAST(month(datetime) AS INTEGER) AS month, CAST(hour(datetime) AS INTEGER) AS hour FROM m WHERE rn > 5""")
def gap_features(t):
    out = fe.gap_features(daily(t), ["stationid"], "datetime", "precip_sum", 3, 2, time_slices("datetime", "year"))
    return out.select("stationid", "datetime", F.col("precip_sum").alias("y"), F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"), "month", "hour")


REG = "reg AS (SELECT datetime, avg(precip) AS avg, count(*) FILTER (precip >= 0) AS ge, count(*) FILTER (precip > 0) AS gt FROM obsh GROUP BY 1)"


@query("wn_11_lag_differences", f"""WITH {OBSH}, {REG}, l AS (SELECT datetime, {', '.join(f'lag(avg, {k}) OVER (ORDER BY datetime) AS a{k}' for k in range(1, 9))}, row_number() OVER (ORDER BY datetime) AS rn FROM reg)
SELECT datetime, {', '.join(f'round(a{k} - a{k + 1}, 6) AS d{k}' for k in range(1, 8))} FROM l WHERE rn > 8""")
def lag_differences(t):
    from skyloom.slicing import own_rows, row_frames

    reg = rs.regional_summary(t.obsh, "datetime", "precip")
    frame, w = row_frames(reg, [], ["datetime"], time_slices("datetime", "month"), before=8)
    lags = own_rows(frame.withColumn("lags", fe._lags("avg", w, 8))).where(F.size("lags") == 8)
    out = fe.lag_differences(lags, "lags")
    return rounded(out.select("datetime", *[F.col("diffs")[k - 1].alias(f"d{k}") for k in range(1, 8)]))


@query("wn_12_wet_flag", f"""WITH {OBSH}, {REG}, s AS (SELECT datetime, sum(avg) OVER (ORDER BY datetime ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS rain_sum FROM reg)
SELECT datetime, round(rain_sum, 6) AS rain_sum, CAST(rain_sum > 0 AS INTEGER) AS is_wet FROM s""")
def wet_flag(t):
    reg = rs.regional_summary(t.obsh, "datetime", "precip").select("datetime", "avg")
    return rounded(fe.wet_flag(reg, "datetime", "avg", 8).drop("avg"))


@query("wn_13_pct_wet", f"""WITH {OBSH}, {REG}, s AS (SELECT datetime, CASE WHEN ge > 0 THEN gt / ge END AS share FROM reg)
SELECT datetime, {', '.join(f'round(lag(share, {k}) OVER (ORDER BY datetime), 6) AS p{k}' for k in range(1, 9))} FROM s""")
def pct_wet(t):
    reg = rs.regional_summary(t.obsh, "datetime", "precip")
    out = fe.pct_wet(reg, "datetime", 8)
    return rounded(out.select("datetime", *[F.get("pct_wet", F.lit(k - 1)).alias(f"p{k}") for k in range(1, 9)]))


# --- joins on time -------------------------------------------------------------------------------------------------
@query("jn_05_calendar_grid", f"WITH {OBSH}, {GRID_H} SELECT stationid, datetime, round(precip, 6) AS precip FROM dense")
def grid(t):
    return rounded(fe.densify(t.obsh.select("stationid", "datetime", "precip"), "stationid", "datetime", "1h"))


SOURCES = """a AS (SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS datetime, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS datetime, max(l_discount) AS disc FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
c AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS datetime, count(*) AS orders FROM orders GROUP BY 1)"""
ALIGNED = f"""WITH {SOURCES} SELECT coalesce(a.datetime, b.datetime, c.datetime) AS datetime, qty, disc, orders
 FROM a FULL JOIN b ON a.datetime = b.datetime FULL JOIN c ON coalesce(a.datetime, b.datetime) = c.datetime"""


def sources(t):
    ship = t.lineitem.withColumn("datetime", F.date_trunc("day", "l_shipdate"))
    a = ship.where("l_returnflag = 'A'").groupBy("datetime").agg(F.sum("l_quantity").alias("qty"))
    b = ship.where("l_returnflag <> 'A'").groupBy("datetime").agg(F.max("l_discount").alias("disc"))
    c = t.orders.groupBy(F.date_trunc("day", "o_orderdate").alias("datetime")).agg(F.count("*").alias("orders"))
    return [a, b, c]


@query("jn_06_align_sources", ALIGNED)
def align_sources(t):
    return fe.newest_first(rs.align_sources(sources(t), "datetime"), "datetime")


@query("jn_07_full_align", """WITH a AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS datetime, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderkey, o_totalprice) AS k FROM orders),
b AS (SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS datetime, l_quantity, row_number() OVER (PARTITION BY date_trunc('month', l_shipdate) ORDER BY l_quantity) AS k FROM lineitem)
SELECT coalesce(a.datetime, b.datetime) AS datetime, o_orderkey, o_totalprice, l_quantity FROM a FULL JOIN b ON a.datetime = b.datetime AND a.k = b.k""")
def full_align(t):
    a = t.orders.select(F.date_trunc("month", "o_orderdate").alias("datetime"), "o_orderkey", "o_totalprice")
    return rs.full_align([a, t.lineitem.select(F.date_trunc("month", "l_shipdate").alias("datetime"), "l_quantity")], "datetime")


@query("jn_08_attach_aux_lags", f"""WITH {OBSH}, {FILLED_H},
l AS (SELECT *, lag(precip, 1) OVER w AS l1, lag(precip, 2) OVER w AS l2, row_number() OVER w AS rn FROM filled WINDOW w AS (PARTITION BY stationid ORDER BY datetime)),
k AS (SELECT * FROM l WHERE rn > 2)
SELECT p.stationid, p.datetime, round(p.precip, 6) AS y,
 {', '.join(f'''round(CASE WHEN p.stationid = '{s}' THEN p.l{i} END, 6) AS "{s}_precip_lag_{i}"''' for s in '012' for i in (1, 2))},
 {', '.join(f'round(x{s}.l{i}, 6) AS "{s}_precip_lag_{i}"' for s in '34' for i in (1, 2))}
FROM k p {' '.join(f"LEFT JOIN k x{s} ON x{s}.stationid = '{s}' AND x{s}.datetime = p.datetime" for s in '34')} WHERE p.stationid IN ('0', '1', '2')""")
def aux_lags(t):
    lagged = fe.lag_features(t.obsh, "precip", lookback_days=2 / 24, freq="1h")
    return rounded(fe.attach_aux_lags(lagged, ["precip"], list("01234"), ["3", "4"], 2))


@query("jn_09_align_to_target", f"""WITH {OBSH} SELECT p.datetime, round(p.precip, 6) AS precip, round(a.precip, 6) AS precip_1, round(b.precip, 6) AS precip_2
FROM obsh p LEFT JOIN obsh a ON a.stationid = '1' AND a.datetime = p.datetime LEFT JOIN obsh b ON b.stationid = '2' AND b.datetime = p.datetime WHERE p.stationid = '0'""")
def align_target(t):
    return rounded(fe.align_to_target(t.obsh, "0", ["1", "2"], ["precip"], "stationid", "datetime"))


@query("jn_14_merge_target_neighbour", f"""WITH {OBSH}, a AS (SELECT datetime, avg(precip) AS precip, count(*) AS n FROM obsh WHERE stationid = '0' GROUP BY 1),
b AS (SELECT datetime, avg(precip) AS precip, count(*) AS m FROM obsh WHERE stationid <> '0' GROUP BY 1)
SELECT a.datetime, round(a.precip, 8) AS precip, a.n, round(b.precip, 8) AS precip_target, b.m FROM a LEFT JOIN b ON a.datetime = b.datetime""")
def merge_tn(t):
    mean = lambda cond, n: t.obsh.where(cond).groupBy("datetime").agg(F.avg("precip").alias("precip"), F.count("*").alias(n))
    return rounded(fe.merge_target_neighbour(mean("stationid = '0'", "n"), mean("stationid <> '0'", "m"), "datetime"), 8)


@query("jn_15_merge_aux", f"""WITH {OBSH}, a AS (SELECT datetime, avg(precip) AS x FROM obsh WHERE stationid IN ('1', '2') GROUP BY 1),
b AS (SELECT datetime, max(precip) AS z FROM obsh WHERE stationid IN ('3', '4') GROUP BY 1)
SELECT coalesce(a.datetime, b.datetime) AS datetime, CASE WHEN a.datetime IS NOT NULL THEN '0' END AS stationid, round(x, 6) AS x, round(z, 6) AS z FROM a FULL JOIN b ON a.datetime = b.datetime""")
def merge_aux(t):
    a = t.obsh.where("stationid in ('1', '2')").groupBy("datetime").agg(F.avg("precip").alias("x")).withColumn("stationid", F.lit("0"))
    b = t.obsh.where("stationid in ('3', '4')").groupBy("datetime").agg(F.max("precip").alias("z")).withColumn("stationid", F.lit("0"))
    return rounded(rs.merge_aux([a, b], "datetime"))


# --- order ---------------------------------------------------------------------------------------------------------
@query("st_01_order_series", f"WITH {OBSD} SELECT * FROM obsd ORDER BY stationid, datetime")
def order_series(t):
    return fe.order_series(t.obsd)


@query("st_02_newest_first", f"WITH {OBSD} SELECT * FROM obsd ORDER BY datetime DESC, stationid")
def newest_first(t):
    return fe.newest_first(t.obsd, "datetime", ["stationid"])

"""Checked queries: whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import evaluate as ev
from skyloom.operators import stations as st
from skyloom.plans import jobs
from skyloom.plans.q_features import rounded
from skyloom.plans.q_records import HUM, METRICS, PRECIP, TEMP
from skyloom.plans.q_sources import station_files, stored_csv
from skyloom.plans.q_stations import hav
from skyloom.registry import query
from skyloom.slicing import time_slices
from skyloom.sources.tables import OBSH, PRED

IDS = ["100", "101", "102", "104"]
H = """h AS (SELECT '10' || CAST(user_id % 5 AS VARCHAR) AS s, date_trunc('hour', ts) AS d, sum(value) AS a, avg(event_id % 30) AS b FROM events WHERE user_id % 5 <> 3 GROUP BY 1, 2)"""


def _fill(c):
    return f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN p{c} IS NOT NULL AND n{c} IS NOT NULL THEN p{c} + (n{c} - p{c}) * (epoch_us(d) - epoch_us(pt{c})) / (epoch_us(nt{c}) - epoch_us(pt{c})) ELSE coalesce(p{c}, n{c}) END AS {c}"""


def _near(c):
    return f"""last_value({c} IGNORE NULLS) OVER bk AS p{c}, last_value(CASE WHEN {c} IS NOT NULL THEN d END IGNORE NULLS) OVER bk AS pt{c},
 first_value({c} IGNORE NULLS) OVER fw AS n{c}, first_value(CASE WHEN {c} IS NOT NULL THEN d END IGNORE NULLS) OVER fw AS nt{c}"""


def _frame(rows):
    return f"OVER (PARTITION BY s ORDER BY d ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


_LAGS = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for c in "ab" for k in (1, 2, 3))
_NAMES = {"a": "precip_sum", "b": "temp_mean"}
_WIDE = ", ".join(f'round({x}.{c}{k}, 5) AS "{s}_{_NAMES[c]}_lag_{k}"' for x, s in (("p", "100"), ("x1", "101"), ("x2", "102"), ("x4", "104")) for c in "ab" for k in (1, 2, 3))
_AUX = {"u": "100_precip_sum_sum_3d", "v": "100_temp_mean_max_3d", "mu": "multistations_precip_sum_sum_3d", "mv": "multistations_temp_mean_max_3d"}
_AUXLAG = ", ".join(f'round({c}{k}, 5) AS "{n}_lag_{k}"' for c, n in _AUX.items() for k in (1, 2, 3))


@query("pl_01_build_model_frame", f"""WITH {H}, g AS (SELECT s, unnest(generate_series(min(d), max(d), INTERVAL 1 HOUR)) AS d FROM h GROUP BY 1),
 e AS (SELECT g.s, g.d, a, b FROM g LEFT JOIN h ON h.s = g.s AND h.d = g.d),
 n AS (SELECT *, {_near('a')}, {_near('b')} FROM e WINDOW bk AS (PARTITION BY s ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), fw AS (PARTITION BY s ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 f AS (SELECT s, d, {_fill('a')}, {_fill('b')} FROM n),
 l AS (SELECT * FROM (SELECT *, {_LAGS}, row_number() OVER w AS rn FROM f WINDOW w AS (PARTITION BY s ORDER BY d)) WHERE rn > 3),
 r AS (SELECT s, d, CASE WHEN count(a) {_frame(3)} = 3 THEN sum(a) {_frame(3)} END AS ra, CASE WHEN count(b) {_frame(3)} = 3 THEN max(b) {_frame(3)} END AS rb FROM h),
 own AS (SELECT d, coalesce(ra, 0) AS u, rb AS v FROM r WHERE s = '100'), oth AS (SELECT d, coalesce(sum(ra), 0) AS mu, max(rb) AS mv FROM r WHERE s <> '100' GROUP BY 1),
 aux AS (SELECT own.d, u, v, mu, mv FROM own LEFT JOIN oth ON oth.d = own.d),
 al AS (SELECT d, {', '.join(f'lag({c}, {k}) OVER (ORDER BY d) AS {c}{k}' for c in _AUX for k in (1, 2, 3))} FROM aux)
SELECT p.d AS datetime, p.s AS stationid, CASE WHEN p.a < 1 THEN 0 WHEN p.a < 5 THEN 1 WHEN p.a < 20 THEN 2 ELSE 3 END AS y, {_WIDE}, {_AUXLAG}
FROM l p {' '.join(f"LEFT JOIN l x{i} ON x{i}.s = '10{i}' AND x{i}.d = p.d" for i in (1, 2, 4))} LEFT JOIN al ON al.d = p.d WHERE p.s = '100'""")
def build_model_frame(t):
    n = (F.col("user_id") % 5).cast("double")
    meta = t.events.select(F.concat(F.lit("10"), (F.col("user_id") % 5).cast("string")).alias("stid"), (n * 0.3 + 40).alias("latitude"), (n * 0.2 - 100).alias("longitude")).distinct()
    config = jobs.FrameConfig(
        jobs.StationRules(table=stored_csv(meta, "meta"), radius_miles=60.0, also=["104"]),
        jobs.SeriesRules(folder=station_files(t), summary={"precip": ["sum"], "temp": ["mean"]}, period="1h"),
        jobs.FeatureRules(
            lag_days=0.125, last_years=1, variables=["temp_mean"], without_keys=False, neighbours=True, target_too=True,
            neighbour_summary={"precip_sum": ["sum"], "temp_mean": ["max"]}, windows=[3],
        ),
    )
    return rounded(jobs.build_model_frame(t.spark, config, "100", target_var="precip_sum"), 5)


def _relative(prefix, measure, col, table):
    return f"""SELECT STATION, '{measure}' AS measure, '{prefix}D' || lpad(CAST(date_diff('day', Date_YYYYMMDD, DATE '2024-02-01') AS VARCHAR), 6, '0') || 'H' || HOUR AS var_name,
 round({col}, 6) AS value, DATE '2024-02-01' AS ref_date FROM {table}"""


@query("pl_02_clean_records", f"""WITH {PRECIP}{TEMP[TEMP.index(', temp AS'):]}{HUM[HUM.index(', hum AS'):]}
{_relative('PR', 'precip', 'precip_depth_sum_mm', 'precip')} UNION ALL {_relative('AT', 'temperature', 'air_temp_degrees_cels', 'temp')} UNION ALL {_relative('RH', 'humidity', 'Rel_Hum_pct', 'hum')}""")
def clean_records(t):
    return rounded(jobs.clean_records(t.rawrec, "2024-02-01", METRICS))


REGION = f"""{OBSH}, stn AS (SELECT DISTINCT stationid AS s, CAST(stationid AS INTEGER) * CAST(0.3 AS DOUBLE) + 40 AS a, CAST(stationid AS INTEGER) * CAST(0.2 AS DOUBLE) - 100 AS b FROM obsh),
 pr AS (SELECT x.s AS tgt, y.s AS feat FROM stn x, stn y WHERE {hav('x.a', 'x.b', 'y.a', 'y.b', 6371.0)} <= 100),
 area AS (SELECT tgt, o.datetime, avg(precip) AS avg, count(*) FILTER (precip >= 0) AS ge, count(*) FILTER (precip > 0) AS gt, max(precip) FILTER (feat = tgt) AS target, bool_or(feat = tgt) AS has FROM pr JOIN obsh o ON o.stationid = feat GROUP BY 1, 2),
 l AS (SELECT *, {', '.join(f'lag({c}, {k}) OVER w AS {c}{k}' for c in ('avg', 'ge', 'gt') for k in (1, 2, 3))}, row_number() OVER w AS rn FROM area WHERE has WINDOW w AS (PARTITION BY tgt ORDER BY datetime)),
 k AS (SELECT *, row_number() OVER (PARTITION BY tgt ORDER BY md5(concat_ws('|', tgt, strftime(datetime, '%Y-%m-%d %H:%M:%S'), '0')), datetime) AS no, count(*) OVER (PARTITION BY tgt) AS n
  FROM l WHERE rn > 3 AND target IS NOT NULL AND (avg1 > 0 OR avg2 > 0 OR avg3 > 0))"""


@query("pl_03_regional_frame", f"""WITH {REGION} SELECT tgt AS tgt_stid, datetime, CASE WHEN target <= .1 THEN 0.0 WHEN target <= .5 THEN 0.1 WHEN target <= 1 THEN 0.5 WHEN target <= 2 THEN 1.0 WHEN target <= 3 THEN 2.0 WHEN target <= 4 THEN 3.0 WHEN target <= 5 THEN 4.0 ELSE 5.0 END::DOUBLE AS tgt_bin,
 CAST(month(datetime) AS INTEGER) AS month, CAST(hour(datetime) AS INTEGER) AS hour, {', '.join(f'round(avg{k}, 8) AS avg_{k}, ge{k} AS ge_{k}, gt{k} AS gt_{k}' for k in (1, 2, 3))},
 CASE WHEN no <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN no <= floor(n * 0.7 + 1e-9) + floor(n * 0.15 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM k""")
def regional_frame(t):
    n = F.col("stationid").cast("int")
    stations = t.obsh.select("stationid").distinct().select(F.col("stationid").alias("stid"), (n * 0.3 + 40).alias("latitude"), (n * 0.2 - 100).alias("longitude"))
    out = jobs.regional_frame(t.obsh, st.station_pairs(stations, 100.0), "precip", 3)
    lags = [F.col(f"{c}_lags")[k - 1].alias(f"{s}_{k}") for k in (1, 2, 3) for c, s in (("avg", "avg"), ("cnt_ge0", "ge"), ("cnt_gt0", "gt"))]
    return rounded(out.select("tgt_stid", "datetime", "tgt_bin", "month", "hour", *lags, "split"), 8)


_DAY = "RANGE BETWEEN CURRENT ROW AND INTERVAL '86399.999999 seconds' FOLLOWING"


@query("pl_04_day_summary_frame", f"""WITH {OBSH}, r AS (SELECT stationid, datetime, sum(coalesce(precip, 0)) OVER w AS s, CASE WHEN count(precip) OVER w >= 6 THEN avg(precip) OVER w END AS m FROM obsh WINDOW w AS (PARTITION BY stationid ORDER BY datetime {_DAY})),
 l AS (SELECT *, lag(s, 24) OVER w AS s1, lag(m, 24) OVER w AS m1, lag(s, 71) OVER w AS s48, lag(m, 71) OVER w AS m48, row_number() OVER w AS rn FROM r WINDOW w AS (PARTITION BY stationid ORDER BY datetime)),
 k AS (SELECT *, row_number() OVER (PARTITION BY stationid ORDER BY md5(concat_ws('|', stationid, strftime(datetime, '%Y-%m-%d %H:%M:%S'), '0')), datetime) AS no, count(*) OVER (PARTITION BY stationid) AS n FROM l WHERE rn >= 72)
SELECT stationid, datetime, CASE WHEN s <= 1 THEN 0 WHEN s <= 5 THEN 1 WHEN s <= 20 THEN 2 ELSE 3 END AS tgt_bin, CAST(month(datetime) AS INTEGER) AS month, CAST(hour(datetime) AS INTEGER) AS hour,
 round(s1, 6) AS s1, round(m1, 6) AS m1, round(s48, 6) AS s48, round(m48, 6) AS m48, CASE WHEN no <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN no <= floor(n * 0.7 + 1e-9) + floor(n * 0.15 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM k""")
def day_summary_frame(t):
    out = jobs.day_summary_frame(t.obsh, "precip", gap_days=1, history_days=2)
    h = F.col("history")
    cols = [h[0]["precip_sum"].alias("s1"), h[0]["precip_mean"].alias("m1"), h[47]["precip_sum"].alias("s48"), h[47]["precip_mean"].alias("m48")]
    return rounded(out.select("stationid", "datetime", "tgt_bin", "month", "hour", *cols, "split"))


@query("pl_05_merged_series_frame", """WITH a AS (SELECT l_shipdate AS datetime, sum(l_quantity) AS qty FROM lineitem GROUP BY 1), b AS (SELECT o_orderdate AS datetime, avg(o_totalprice) AS price FROM orders GROUP BY 1),
 m AS (SELECT coalesce(a.datetime, b.datetime) AS datetime, qty, price FROM a FULL JOIN b ON a.datetime = b.datetime),
 w AS (SELECT CAST(date_trunc('week', datetime) AS TIMESTAMP) AS datetime, sum(qty) AS qty_sum, avg(price) AS price_mean FROM m GROUP BY 1),
 l AS (SELECT *, lag(qty_sum, 1) OVER (ORDER BY datetime) AS qty_sum_lag_1, lag(qty_sum, 2) OVER (ORDER BY datetime) AS qty_sum_lag_2, row_number() OVER (ORDER BY datetime) AS no, count(*) OVER () AS n FROM w)
SELECT CASE WHEN qty_sum >= 0 AND qty_sum < 4000 THEN 0 WHEN qty_sum >= 4000 AND qty_sum < 4300 THEN 1 ELSE 2 END AS label, datetime, qty_sum, round(price_mean, 6) AS price_mean, qty_sum_lag_1, qty_sum_lag_2,
 CASE WHEN no <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN no <= floor(n * 0.7 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM l""")
def merged_series_frame(t):
    a = t.lineitem.groupBy(F.col("l_shipdate").alias("datetime")).agg(F.sum("l_quantity").alias("qty"))
    b = t.orders.groupBy(F.col("o_orderdate").alias("datetime")).agg(F.avg("o_totalprice").alias("price"))
    out = jobs.merged_series_frame([a, b], "datetime", "1w", {"qty": "sum", "price": "mean"}, "qty_sum", 2, [0, 4000, 4300, 1e12], [0, 1, 2], slices=time_slices("datetime", "year"))
    return rounded(out)


@query("pl_06_combine_predictions", f"""WITH {PRED} SELECT id, actual, predicted, CASE WHEN ascii(substr(id, 1, 1)) % 3 = 0 THEN 'test' WHEN ascii(substr(id, 1, 1)) % 3 = 1 THEN 'train' ELSE 'valid' END AS part,
 round(prob, 6) AS pval_1, round(1 - prob, 6) AS pval_0 FROM pred""")
def combine(t):
    p = t.pred.withColumn("extra", F.concat(F.lit("{'0': "), F.format_string("%.9f", 1 - F.col("prob")), F.lit(", '1': "), F.format_string("%.9f", F.col("prob")), F.lit("}")))
    rest = F.ascii(F.substring("id", 1, 1)) % 3
    parts = {name: p.where(rest == i).select("id", "actual", "predicted", "extra") for i, name in enumerate(("test", "train", "valid"))}
    return rounded(jobs.combine_predictions(parts, "extra", [0, 1]))


@query("pl_06_prediction_summary", f"""WITH {PRED}, c AS (SELECT CASE WHEN ascii(substr(id, 1, 1)) % 2 = 0 THEN 'test' ELSE 'train' END AS part, actual <> 0 AS a, predicted <> 0 AS p FROM pred)
SELECT part, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM c GROUP BY 1""")
def prediction_summary(t):
    rest = F.ascii(F.substring("id", 1, 1)) % 2
    parts = {name: t.pred.where(rest == i).withColumn("extra", F.lit("{'0': 1}")) for i, name in enumerate(("test", "train"))}
    return ev.binary_summary(jobs.combine_predictions(parts, "extra", [0]), "actual", "predicted", ["part"]).select("part", "tp", "fp", "fn", "tn")


@query("pl_03_errors", f"""WITH {OBSH}, w AS (SELECT DISTINCT CAST(user_id % 8 AS VARCHAR) AS s FROM events), c AS (SELECT stationid, count(*) AS n FROM obsh GROUP BY 1)
SELECT s AS tgt_stid, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no readings' ELSE 'too few periods' END AS reason FROM w LEFT JOIN c ON stationid = s WHERE coalesce(n, 0) <= 672""")
def regional_errors(t):
    wanted = t.events.select((F.col("user_id") % 8).cast("string").alias("tgt_stid")).distinct()
    return jobs.regional_errors(t.obsh, wanted, 672)


@query("pl_04_errors", f"WITH {OBSH} SELECT stationid, count(*) AS n, 'too few periods' AS reason FROM obsh GROUP BY 1 HAVING count(*) < 28 * 24")
def day_summary_errors(t):
    return jobs.day_summary_errors(t.obsh, gap_days=1, history_days=27)


@query("pl_08_score_table", """WITH l AS (SELECT event_id, user_id, value * 0.5 AS a, user_id * -0.25 + 1 AS b, value * 0.1 + user_id AS c FROM events), g AS (SELECT *, greatest(a, b, c) AS m FROM l)
SELECT event_id, CASE WHEN a = m THEN 0 WHEN b = m THEN 1 ELSE 2 END AS "Predicted", round(1 / (exp(a - m) + exp(b - m) + exp(c - m)), 6) AS "Probability" FROM g""")
def score_table(t):
    from skyloom.plans.q_models import linear
    from skyloom.session import scratch_path

    source = scratch_path(t.spark, "table") + ".parquet"
    t.events.select("event_id", "value", F.col("user_id").cast("double").alias("user"), "event_type").write.parquet(source)
    path = jobs.score_table(t.spark, source, linear, ["event_id"], ["value", "user"], "event_type", scratch_path(t.spark, "scores"), "events")
    return rounded(t.spark.read.parquet(path).select("event_id", "Predicted", "Probability"))

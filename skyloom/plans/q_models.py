"""Checked queries: models and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import models as md
from skyloom.plans.q_features import DAILY, daily, rounded
from skyloom.registry import query
from skyloom.session import scratch_path
from skyloom.slicing import time_slices
from skyloom.sources.tables import OBS, OBSD
from skyloom.streaming import streams as sm


def risk(t):
    late = (F.col("l_quantity") + F.col("l_discount") * 300 + (F.col("l_suppkey") % 7) * 4 > 45).cast("int")
    tax = F.nullif("l_tax", F.lit(0.03))  # some values are missing
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", tax.alias("l_tax"), "l_extendedprice", late.alias("y"))


COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]

# neighbouring bins merge row by row of a recursion: one merge per variable and level, the last level of a variable counts
_PROBS = "[" + ", ".join(f"{i / 20!r}::DOUBLE" for i in range(1, 20)) + "]"
_P, _Q = "greatest({pos}, 0.5::DOUBLE) / greatest(ap, 1)", "greatest({n} - {pos}, 0.5::DOUBLE) / greatest(an - ap, 1)"


def _woe(n, pos):
    return f"ln(({_P.format(pos=pos)}) / ({_Q.format(n=n, pos=pos)}))"


def _iv(n, pos):
    return f"(({_P.format(pos=pos)}) - ({_Q.format(n=n, pos=pos)})) * {_woe(n, pos)}"


WOE = f"""risk AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, CASE WHEN l_tax <> 0.03::DOUBLE THEN l_tax END AS l_tax, l_extendedprice,
  CASE WHEN l_quantity + l_discount * 300 + (l_suppkey % 7) * 4 > 45 THEN 1 ELSE 0 END AS y FROM lineitem),
 long AS ({' UNION ALL '.join(f"SELECT '{c}' AS var, {c} AS x, y FROM risk" for c in COLS)}),
 edges AS (SELECT var, list_sort(list_distinct(quantile_cont(x, {_PROBS}))) AS e FROM long WHERE x IS NOT NULL GROUP BY 1),
 placed AS (SELECT var, e, y, CASE WHEN x IS NULL THEN -1 ELSE len([v FOR v IN e IF v < x]) END AS bin FROM long JOIN edges USING (var)),
 counts AS (SELECT var, bin, CASE WHEN bin >= 0 THEN any_value(e)[bin + 1] END AS hi, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM placed GROUP BY 1, 2),
 sizes AS (SELECT var, CAST(sum(n) AS BIGINT) AS an, CAST(sum(pos) AS BIGINT) AS ap FROM counts GROUP BY 1),
 merge(var, level, bin, hi, n, pos, an, ap) AS (SELECT var, 0, bin, hi, n, pos, an, ap FROM counts JOIN sizes USING (var) WHERE bin >= 0
  UNION ALL SELECT var, level + 1, bin, CASE WHEN k = pick THEN hi2 ELSE hi END, CASE WHEN k = pick THEN n + n2 ELSE n END, CASE WHEN k = pick THEN pos + pos2 ELSE pos END, an, ap
  FROM (SELECT *, first_value(k) OVER best AS pick, first_value(cost) OVER best AS least FROM
   (SELECT *, CASE WHEN n2 IS NULL THEN NULL WHEN bad IS NULL THEN round(iv + iv2 - {_iv('(n + n2)', '(pos + pos2)')}, 12) WHEN k IN (bad, bad - 1) THEN round(abs(woe - woe2), 12) END AS cost FROM
    (SELECT *, count(*) OVER v AS c, sum(iv) OVER v AS total, min(CASE WHEN small THEN k END) OVER v AS bad, lead(woe) OVER o AS woe2, lead(iv) OVER o AS iv2 FROM
     (SELECT *, {_woe('n', 'pos')} AS woe, {_iv('n', 'pos')} AS iv, n < 0.05::DOUBLE * an OR pos < 0.001::DOUBLE * ap OR n - pos < 0.001::DOUBLE * (an - ap) AS small,
       row_number() OVER o AS k, lead(hi) OVER o AS hi2, lead(n) OVER o AS n2, lead(pos) OVER o AS pos2 FROM merge WINDOW o AS (PARTITION BY var ORDER BY bin)) a
     WINDOW v AS (PARTITION BY var), o AS (PARTITION BY var ORDER BY bin)) b) d
   WINDOW best AS (PARTITION BY var ORDER BY cost NULLS LAST, k)) f
  WHERE c > 1 AND k <> pick + 1 AND (bad IS NOT NULL OR (c > 2 AND total > 0 AND least <= 0.1::DOUBLE * total))),
 final AS (SELECT var, CAST(row_number() OVER (PARTITION BY var ORDER BY bin) - 1 AS INTEGER) AS bin, false AS is_missing, CASE WHEN lead(bin) OVER (PARTITION BY var ORDER BY bin) IS NOT NULL THEN hi END AS hi, n, pos, an, ap
   FROM (SELECT * FROM merge QUALIFY level = max(level) OVER (PARTITION BY var))),
 every AS (SELECT * FROM final UNION ALL SELECT var, (SELECT CAST(count(*) AS INTEGER) FROM final f WHERE f.var = c.var), true, NULL, n, pos, an, ap FROM counts c JOIN sizes USING (var) WHERE bin < 0),
 bins AS (SELECT var, bin, is_missing, hi, n, pos, {_woe('n', 'pos')} AS woe, sum({_iv('n', 'pos')}) OVER (PARTITION BY var) AS iv FROM every)"""


def _coded(c):
    """The evidence of the bin that a row's value falls into."""
    return f"LEFT JOIN LATERAL (SELECT woe FROM bins b WHERE b.var = '{c}' AND CASE WHEN r.{c} IS NULL THEN is_missing ELSE NOT is_missing AND (hi IS NULL OR r.{c} <= hi) END ORDER BY bin LIMIT 1) w_{c} ON true"


@query("ml_01_woe_fit", f"WITH RECURSIVE {WOE} SELECT var, bin, is_missing, round(hi, 6) AS hi, n, pos, round(woe, 6) AS woe, round(iv, 6) AS iv FROM bins")
def woe_fit(t):
    return rounded(md.woe_fit(risk(t), "y", COLS))


@query("ml_01_woe_apply", f"WITH RECURSIVE {WOE} SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'round(w_{c}.woe, 6) AS {c}_woe' for c in COLS)} FROM risk r {' '.join(_coded(c) for c in COLS)}")
def woe_apply(t):
    df = risk(t)
    bins = md.woe_fit(df, "y", COLS)
    return rounded(md.woe_apply(df, bins, COLS).select("l_orderkey", "l_linenumber", "l_partkey", *[f"{c}_woe" for c in COLS]))


@query("ml_01_woe_select", f"WITH RECURSIVE {WOE} SELECT DISTINCT var, round(iv, 6) AS iv FROM bins WHERE iv >= 0.4")
def woe_select(t):
    return rounded(md.woe_select(md.woe_fit(risk(t), "y", COLS), 0.4))


@query("ml_02_logistic")
def logistic(t):
    df = risk(t)
    coded = md.woe_apply(df, md.woe_fit(df, "y", COLS), COLS)
    names = [f"{c}_woe" for c in COLS]
    out = md.predict_logistic(coded, md.fit_logistic(coded, "y", names), ["l_orderkey", "l_linenumber", "l_partkey", "y"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "y", "Predicted", F.round(F.col("probs")[1], 4).alias("p1"))


WEIGHTS = [0.5, -0.25, 1.0]


def linear(x: np.ndarray) -> np.ndarray:
    """Scorer of the check: three class logits from two inputs."""
    return np.stack([x[:, 0] * 0.5, x[:, 1] * -0.25 + 1, x[:, 0] * 0.1 + x[:, 1]], axis=1)


_LOGITS = "l AS (SELECT event_id, value / 100 * 0.5 AS a, (event_id % 10) * -0.25 + 1 AS b, value / 100 * 0.1 + event_id % 10 AS c FROM events)"


@query("ml_03_score", f"""WITH {_LOGITS}, g AS (SELECT *, greatest(a, b, c) AS m FROM l), p AS (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS z FROM g)
SELECT event_id, CASE WHEN a = m THEN 0 WHEN b = m THEN 1 ELSE 2 END AS "Predicted", round(1 / z, 6) AS "Probability", round(exp(a - m) / z, 6) AS p0, round(exp(b - m) / z, 6) AS p1, round(exp(c - m) / z, 6) AS p2 FROM p""")
def score(t):
    df = t.events.select("event_id", (F.col("value") / 100).alias("x"), (F.col("event_id") % 10).cast("double").alias("z"))
    out = md.score(df, linear, ["x", "z"])
    return rounded(out.select("event_id", "Predicted", "Probability", *[F.col("probs")[i].alias(f"p{i}") for i in range(3)]))


@query("ml_03_score_regression", """SELECT event_id, round(value * 2 + 1, 6) AS "Predicted" FROM events""")
def score_value(t):
    return rounded(md.score(t.events.select("event_id", "value"), lambda x: x[:, 0] * 2 + 1, ["value"], "regression").select("event_id", "Predicted"))


AR = f"""WITH {OBSD}, {DAILY}, n AS (SELECT stationid, datetime, precip_sum AS y, lag(precip_sum) OVER w AS x, row_number() OVER w AS pos, floor(count(*) OVER (PARTITION BY stationid) * 0.8 + 1e-9) AS t FROM daily WINDOW w AS (PARTITION BY stationid ORDER BY datetime)),
 f AS (SELECT stationid, regr_slope(y, x) FILTER (pos <= t) AS b, regr_intercept(y, x) FILTER (pos <= t) AS a, max(y) FILTER (pos = t) AS last FROM n GROUP BY 1),
 o AS (SELECT n.stationid, datetime, CAST(pos - t AS BIGINT) AS step, y AS actual, pow(b, pos - t) * last + a * (1 - pow(b, pos - t)) / (1 - b) AS forecast FROM n JOIN f ON f.stationid = n.stationid WHERE pos > t)"""


@query("ml_04_ar1_forecast", f"{AR} SELECT stationid, datetime, step, actual, round(forecast, 5) AS forecast FROM o")
def ar1(t):
    out = md.ar1_forecast(daily(t).select("stationid", "datetime", "precip_sum"), ["stationid"], ["datetime"], "precip_sum", time_slices("datetime", "year"))
    return rounded(out, 5, ["forecast"])


@query("ml_04_ar1_errors", f"{AR}, s AS (SELECT stationid, avg(pow(forecast - actual, 2)) AS m FROM o GROUP BY 1) SELECT round(avg(pow(forecast - actual, 2)), 4) AS mse, round(avg(abs(forecast - actual)), 5) AS mae, round(sqrt(avg(pow(forecast - actual, 2))), 5) AS rmse, (SELECT round(avg(sqrt(m)), 5) FROM s) AS forecast_rmse FROM o")
def ar1_errors(t):
    from skyloom.operators.evaluate import regression_metrics

    out = md.ar1_forecast(daily(t).select("stationid", "datetime", "precip_sum"), ["stationid"], ["datetime"], "precip_sum", time_slices("datetime", "year"))
    m = regression_metrics(out, "actual", "forecast", ["stationid"])
    return m.withColumn("mse", F.round("mse", 4)).withColumns({c: F.round(c, 5) for c in ("mae", "rmse", "forecast_rmse")})


# --- cells and groups ----------------------------------------------------------------------------------------------
def start_centres(t):
    return t.embeddings.where("vec_id < 20").select(F.col("vec_id").cast("int").alias("cell"), F.col("embedding").alias("centre"))


CELLS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT CAST(vec_id AS INTEGER) AS cell, e AS centre FROM v WHERE vec_id < 20),
 placed AS (SELECT vec_id, label, e, cell FROM v, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(pow(list_distance(e, centre), 2), 12), cell) = 1)"""


@query("ml_05_assign_cells", f"WITH {CELLS} SELECT vec_id, cell FROM placed")
def assign_cells(t):
    return md.assign_cells(t.embeddings, "embedding", start_centres(t)).select("vec_id", "cell")


@query("ml_05_lloyd_step", f"""WITH {CELLS}, u AS (SELECT cell, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM placed)
SELECT cell, i, round(avg(x), 6) AS x FROM u GROUP BY 1, 2""")
def lloyd(t):
    out = md.lloyd_step(t.embeddings, "embedding", start_centres(t))
    return rounded(out.select("cell", F.posexplode("centre").alias("i", "x")).withColumn("i", (F.col("i") + 1).cast("long")))


@query("ev_17_ndb_of_cells", f"""WITH {CELLS}, n AS (SELECT count(*) FILTER (label < 5) AS na, count(*) FILTER (label >= 5) AS nb FROM placed),
 k AS (SELECT cell, count(*) FILTER (label < 5) AS ca, count(*) FILTER (label >= 5) AS cb FROM placed GROUP BY 1 HAVING count(*) FILTER (label < 5) > 0),
 p AS (SELECT ca / na AS p1, cb / nb AS p2, (ca + cb) / (na + nb) AS p, na, nb FROM k, n)
SELECT round(count(*) FILTER (abs(p1 - p2) > 1.96 * sqrt(p * (1 - p) * (1 / na + 1 / nb)) AND p * (1 - p) > 0) / 20, 6) AS ndb FROM p""")
def ndb_of_cells(t):
    from skyloom.operators.evaluate import ndb_of_cells as measure

    placed = md.assign_cells(t.embeddings, "embedding", start_centres(t))
    return rounded(measure(placed.where("label < 5"), placed.where("label >= 5"), 20))


@query("ml_02_logistic_groups", """SELECT l_returnflag, l_linestatus, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 3) AS p1 FROM lineitem GROUP BY 1, 2""")
def logistic_groups(t):
    """On indicators of all groups but one, fitted probabilities are the shares of the groups."""
    flag = F.concat("l_returnflag", "l_linestatus")
    names = [r[0] for r in t.lineitem.select(flag).distinct().orderBy(flag).collect()][1:]
    df = t.lineitem.select("l_returnflag", "l_linestatus", (F.col("l_quantity") > 25).cast("int").alias("y"), *[(flag == n).cast("double").alias(f"is_{n}") for n in names])
    fitted = md.fit_logistic(df, "y", [f"is_{n}" for n in names], max_iter=200)
    groups = df.withColumn("y", F.lit(0)).distinct()
    out = md.predict_logistic(groups, fitted, ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", F.round(F.col("probs")[1], 3).alias("p1"))


# --- streams -------------------------------------------------------------------------------------------------------
@query("str_01_resample_stream", f"""WITH {OBS} SELECT stationid, date_trunc('hour', datetime) AS datetime, round(sum(precip), 6) AS precip_sum, max(precip) AS precip_max, count(precip) AS precip_count
FROM obs WHERE date_trunc('hour', datetime) + INTERVAL 1 HOUR <= (SELECT max(datetime) - INTERVAL 2 DAY FROM obs) GROUP BY 1, 2""")
def resample_stream(t):
    schema = t.spark.read.parquet(f"{t.root}/events.parquet").schema
    events = sm.read_stream(t.spark, t.root, schema, glob="events.parquet")
    obs = events.select((F.col("user_id") % 5).cast("string").alias("stationid"), F.col("ts").alias("datetime"), F.col("value").alias("precip"))
    out = sm.resample_stream(obs, "1h", {"precip": ["sum", "max", "count"]}, "2 days")
    base = scratch_path(t.spark, "stream")
    return rounded(sm.run_to_end(out, f"{base}/out", f"{base}/state"))


@query("str_01_resample_stream_week", f"""WITH {OBS} SELECT stationid, CAST(date_trunc('week', datetime) AS TIMESTAMP) AS datetime, round(sum(precip), 6) AS precip_sum, count(precip) AS precip_count
FROM obs WHERE date_trunc('week', datetime) + INTERVAL 7 DAY <= (SELECT max(datetime) - INTERVAL 2 DAY FROM obs) GROUP BY 1, 2""")
def resample_stream_week(t):
    schema = t.spark.read.parquet(f"{t.root}/events.parquet").schema
    events = sm.read_stream(t.spark, t.root, schema, glob="events.parquet")
    obs = events.select((F.col("user_id") % 5).cast("string").alias("stationid"), F.col("ts").alias("datetime"), F.col("value").alias("precip"))
    out = sm.resample_stream(obs, "1w", {"precip": ["sum", "count"]}, "2 days")
    base = scratch_path(t.spark, "stream")
    return rounded(sm.run_to_end(out, f"{base}/out", f"{base}/state"))


_DAYS = "FROM (SELECT *, date_trunc('day', datetime) AS day FROM obs) o WHERE day + INTERVAL 1 DAY <= (SELECT max(datetime) - INTERVAL 2 DAY FROM obs) GROUP BY 1, 2"


def _day_stream(t, ops):
    schema = t.spark.read.parquet(f"{t.root}/events.parquet").schema
    events = sm.read_stream(t.spark, t.root, schema, glob="events.parquet")
    obs = events.select((F.col("user_id") % 5).cast("string").alias("stationid"), F.col("ts").alias("datetime"), F.col("value").alias("precip"), "event_type")
    base = scratch_path(t.spark, "stream")
    return rounded(sm.run_to_end(sm.resample_stream(obs, "1d", ops, "2 days"), f"{base}/out", f"{base}/state"))


@query("str_01_resample_stream_n_unique", f"""WITH obs AS (SELECT CAST(user_id % 5 AS VARCHAR) AS stationid, ts AS datetime, value AS precip, event_type FROM events)
SELECT stationid, CAST(day AS TIMESTAMP) AS datetime, count(DISTINCT precip) AS precip_n_unique, count(DISTINCT event_type) AS event_type_n_unique, count(event_type) AS event_type_count {_DAYS}""")
def resample_stream_n_unique(t):
    return _day_stream(t, {"precip": ["n_unique"], "event_type": ["n_unique", "count"]})


@query("str_01_resample_stream_median", f"""WITH obs AS (SELECT CAST(user_id % 5 AS VARCHAR) AS stationid, ts AS datetime, value AS precip FROM events)
SELECT stationid, CAST(day AS TIMESTAMP) AS datetime, round(median(precip), 6) AS precip_median, round(avg(precip), 6) AS precip_mean {_DAYS}""")
def resample_stream_median(t):
    return _day_stream(t, {"precip": ["median", "mean"]})


@query("str_02_sliding_clips", """WITH c AS (SELECT user_id, value, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 5 HOUR, ts, INTERVAL 1 HOUR)) AS clip_start FROM events)
SELECT user_id, clip_start, clip_start + INTERVAL 6 HOUR AS clip_end, round(avg(value), 6) AS value_mean, max(value) AS value_max, count(*) AS n FROM c GROUP BY 1, 2""")
def clips(t):
    return rounded(sm.sliding_clips(t.events, "user_id", "ts", "6h", "1h", {"value": ["mean", "max"]}))


@query("str_02_sliding_clips_stream", """WITH c AS (SELECT user_id, value, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 5 HOUR, ts, INTERVAL 1 HOUR)) AS clip_start FROM events)
SELECT user_id, clip_start, clip_start + INTERVAL 6 HOUR AS clip_end, round(avg(value), 6) AS value_mean, count(*) AS n FROM c WHERE clip_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def clips_stream(t):
    schema = t.spark.read.parquet(f"{t.root}/events.parquet").schema
    events = sm.read_stream(t.spark, t.root, schema, glob="events.parquet")
    out = sm.sliding_clips(events, "user_id", "ts", "6h", "1h", {"value": ["mean"]}, delay="1 day")
    base = scratch_path(t.spark, "clips")
    return rounded(sm.run_to_end(out, f"{base}/out", f"{base}/state"))

"""Checked queries: bins, calendar features, signals, probabilities and text expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyloom.functions import arrays as ar
from skyloom.functions import calendar as cal
from skyloom.functions import signal as sg
from skyloom.functions.binning import bin_col, cut_and_label
from skyloom.plans.q_features import rounded
from skyloom.registry import query
from skyloom.sources.tables import PROBS


@query("sc_05a_bin_left", "SELECT event_id, CASE WHEN value >= 1 AND value < 5 THEN 0 WHEN value >= 5 AND value < 20 THEN 1 WHEN value >= 20 AND value < 50 THEN 2 END AS y FROM events")
def bin_left(t):
    return t.events.select("event_id", bin_col("value", [1, 5, 20, 50], [0, 1, 2], closed="left", outside="null").alias("y"))


@query("sc_05b_bin_right", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 1 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 ELSE 3 END AS y FROM lineitem")
def bin_right(t):
    y = bin_col("l_quantity", [-math.inf, 1, 10, 25, math.inf], [0, 1, 2, 3], closed="right", outside="null")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", y.alias("y"))


@query("sc_05c_cut_and_label", "SELECT CASE WHEN v >= 0 AND v < 5 THEN 'dry' WHEN v >= 5 AND v < 20 THEN 'light' ELSE 'heavy' END AS label, event_id FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events)")
def cut_label(t):
    v = t.events.select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("v"))
    return cut_and_label(v, "v", [0, 5, 20, 1e9], ["dry", "light", "heavy"]).select("label", "event_id")


@query("sc_22_probability_bands", f"WITH {PROBS}, p AS (SELECT vec_id, 1 / (1 + exp(-list_sum(scores))) AS p FROM probs) SELECT vec_id, CASE WHEN p > 0 AND p <= .4 THEN 0 WHEN p <= .5 THEN 1 WHEN p <= .6 THEN 2 WHEN p <= .7 THEN 3 WHEN p <= .8 THEN 4 WHEN p <= .9 THEN 5 WHEN p <= 1 THEN 6 END AS band FROM p")
def bands(t):
    p = 1 / (1 + F.exp(-ar.total("scores")))
    return t.probs.select("vec_id", bin_col(p, [0, .4, .5, .6, .7, .8, .9, 1], list(range(7)), closed="right", outside="null").alias("band"))


@query("sc_07_time_features", "SELECT event_id, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) // 15 AS INTEGER) AS minute FROM events")
def time_raw(t):
    return t.events.select("event_id", *[c.alias(n) for n, c in cal.time_features("ts", "t").items()])


@query("sc_08_time_features_scaled", """SELECT event_id, round(second(ts) / 59.0 - 0.5, 6) AS second, round(minute(ts) / 59.0 - 0.5, 6) AS minute, round(hour(ts) / 23.0 - 0.5, 6) AS hour,
 round((isodow(ts) - 1) / 6.0 - 0.5, 6) AS weekday, round((day(ts) - 1) / 30.0 - 0.5, 6) AS day, round((dayofyear(ts) - 1) / 365.0 - 0.5, 6) AS dayofyear FROM events""")
def time_scaled(t):
    return rounded(t.events.select("event_id", *[c.alias(n) for n, c in cal.time_features("ts", "s", scaled=True).items()]))


@query("sc_08_week_features", "SELECT l_shipdate, round((day(l_shipdate) - 1) / 30.0 - 0.5, 6) AS day, round((week(l_shipdate) - 1) / 52.0 - 0.5, 6) AS week FROM lineitem")
def time_week(t):
    return rounded(t.lineitem.select("l_shipdate", *[c.alias(n) for n, c in cal.time_features("l_shipdate", "w", scaled=True).items()]))


NAMED = "named AS (SELECT event_id, 'PRD' || lpad(CAST(event_id % 400 AS VARCHAR), 6, '0') || 'H' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') AS var_name FROM events)"


def named(t):
    e = F.col("event_id")
    return t.events.select("event_id", F.concat(F.lit("PRD"), F.lpad((e % 400).cast("string"), 6, "0"), F.lit("H"), F.lpad((e % 24).cast("string"), 2, "0")).alias("var_name"))


REL = f"WITH {NAMED} SELECT event_id, TIMESTAMP '2024-02-01' - to_days(CAST(event_id % 400 AS INTEGER)) + to_hours(event_id % 24) AS datetime FROM named"


@query("sc_09a_decode_relative", REL)
def relative(t):
    return cal.decode_relative(named(t), "var_name", F.lit("2024-02-01").cast("timestamp")).select("event_id", "datetime")


@query("sc_09b_decode_relative_legacy", REL)
def relative_old(t):
    return cal.decode_relative(named(t), "var_name", F.lit("2024-02-01").cast("timestamp"), legacy=True).select("event_id", "datetime")


@query("sc_11_calendar_keys", """SELECT event_id, CAST(month(d) AS INTEGER) AS month, CAST(week(d) AS INTEGER) AS week, CAST(dayofyear(d) AS INTEGER) AS dayofyear, coalesce(TRY_CAST(h AS INTEGER), 0) AS nhour,
 lpad(CAST(coalesce(TRY_CAST(h AS INTEGER), 0) AS VARCHAR), 2, '0') AS hour_text FROM (SELECT event_id, CAST(ts AS DATE) AS d, CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(hour(ts) AS VARCHAR) END AS h FROM events)""")
def calendar_keys(t):
    df = t.events.select("event_id", F.to_date("ts").alias("d"), F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.hour("ts").cast("string")).alias("h"))
    return cal.calendar_keys(df, "d", "h").drop("d", "h")


_ATTR = {
    "day": "day(x)", "hour": "hour(x)", "minute": "minute(x)", "second": "second(x)", "month": "month(x)", "year": "year(x)", "dayofweek": "isodow(x) - 1", "dayofyear": "dayofyear(x)",
    "quarter": "quarter(x)", "week": "week(x)", "is_month_start": "(day(x) = 1)", "is_month_end": "(last_day(x) = CAST(x AS DATE))", "is_quarter_start": "(day(x) = 1 AND month(x) % 3 = 1)",
    "is_quarter_end": "(last_day(x) = CAST(x AS DATE) AND month(x) % 3 = 0)", "is_year_start": "(day(x) = 1 AND month(x) = 1)", "is_year_end": "(day(x) = 31 AND month(x) = 12)",
    "is_leap_year": "((year(x) % 4 = 0 AND year(x) % 100 <> 0) OR year(x) % 400 = 0)",
}


@query("sc_12_timestamp_attributes", "SELECT " + ", ".join(
    f"CAST(CAST({e} AS INTEGER) - {cal.ATTRIBUTE_RANGES[n][0]} AS INTEGER) AS {n}_code, round(2.0 * (CAST({e} AS INTEGER) - {cal.ATTRIBUTE_RANGES[n][0]}) / {cal.ATTRIBUTE_RANGES[n][1] - cal.ATTRIBUTE_RANGES[n][0] + 2} - 1, 6) AS {n}_scaled"
    for n, e in _ATTR.items()) + " FROM (SELECT l_shipdate AS x FROM lineitem)")
def attributes(t):
    codes, scaled = cal.timestamp_attributes("l_shipdate"), cal.timestamp_attributes("l_shipdate", scaled=True)
    return rounded(t.lineitem.select(*[c.alias(f"{n}_code") for n, c in codes.items()], *[c.alias(f"{n}_scaled") for n, c in scaled.items()]))


@query("sc_13_to_number", "SELECT event_id, TRY_CAST(v AS DOUBLE) AS v FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END AS v FROM events)")
def to_number(t):
    text = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.col("event_id").cast("string"))
    return t.events.select("event_id", ar.to_number(text).alias("v"))


UNIT = "unit AS (SELECT vec_id, i, least(1.0, greatest(0.0, (x + 1) / 2)) AS u FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def unit(t):
    df = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return df.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("x").cast("double") + 1) / 2)).alias("u"))


UNIT = UNIT.replace("(x + 1) / 2", "(CAST(x AS DOUBLE) + 1) / 2")


@query("sc_14_quantize", f"WITH {UNIT}, q AS (SELECT vec_id, i, CAST(floor(u * 255.99 + 0.005) AS INTEGER) AS q FROM unit) SELECT vec_id, i, q, round(q / 128.0 - 1, 6) AS back FROM q")
def quantize(t):
    return rounded(unit(t).select("vec_id", "i", sg.quantize("u").alias("q")).withColumn("back", sg.dequantize("q")))


def _mu(variant):
    x = "(2 * u - 1)"
    inner = x if variant == "round" else f"({x} + 1e-8)"
    level = f"(sign({x}) * ln(1 + 255.0 * abs({inner})) / ln(256.0) + 1) / 2"
    q = f"floor({level} * 255.99 + 0.005)" if variant == "quantize" else f"floor({level} * 255 + 0.5)"
    y = "(q / 128.0 - 1)" if variant == "quantize" else "(q / 255.0 * 2 - 1)"
    return f"WITH {UNIT}, m AS (SELECT vec_id, i, CAST({q} AS INTEGER) AS q FROM unit) SELECT vec_id, i, q, round(sign({y}) * (pow(256.0, abs({y})) - 1) / 255.0, 6) AS back FROM m"


for _variant in ("quantize", "round", "round_shifted"):

    def _mu_law(t, variant=_variant):
        df = unit(t).withColumn("x", 2 * F.col("u") - 1).select("vec_id", "i", sg.mu_law_encode("x", 8, variant).alias("q"))
        return rounded(df.withColumn("back", sg.mu_law_decode("q", 8, variant)))

    query(f"sc_15_mu_law_{_variant}", _mu(_variant))(_mu_law)


SOFT = f"""{PROBS}, ent AS (SELECT vec_id, label, unnest(scores) AS s, generate_subscripts(scores, 1) AS i FROM probs),
 soft AS (SELECT vec_id, label, i, s, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p FROM ent)"""


@query("sc_16_softmax", f"WITH {SOFT} SELECT vec_id, CAST(arg_max(i, (s, -i)) - 1 AS INTEGER) AS predicted, round(max(p), 6) AS top, round(max(p) FILTER (i = 1), 6) AS p0 FROM soft GROUP BY 1")
def softmax(t):
    p = t.probs.withColumn("p", ar.softmax("scores"))
    return rounded(p.select("vec_id", ar.argmax("scores").alias("predicted"), F.array_max("p").alias("top"), F.col("p")[0].alias("p0")))


@query("sc_16_two_class", f"WITH {PROBS} SELECT vec_id, round(1 - 1 / (1 + exp(-list_sum(scores))), 6) AS p0, round(1 / (1 + exp(-list_sum(scores))), 6) AS p1 FROM probs")
def two_class(t):
    p = t.probs.withColumn("p", ar.two_class(ar.total("scores")))
    return rounded(p.select("vec_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1")))


@query("sc_17_parse_probs", "SELECT event_id, round(value / 1000, 6) AS pval_0, round(1 - value / 1000, 6) AS pval_1 FROM events")
def parse_probs(t):
    v = F.col("value") / 1000
    text = F.concat(F.lit("{'0': "), F.format_string("%.8f", v), F.lit(", '1': "), F.format_string("%.8f", 1 - v), F.lit("}"))
    p = t.events.select("event_id", text.alias("txt")).withColumn("p", ar.parse_probs("txt"))
    return rounded(p.select("event_id", F.col("p")["0"].alias("pval_0"), F.col("p")["1"].alias("pval_1")))


@query("sc_18_mono", "SELECT vec_id, i, round((CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 32] AS DOUBLE)) / 2, 6) AS x FROM embeddings, generate_series(1, 32) g(i)")
def mono(t):
    wide = F.transform("embedding", lambda x: x.cast("double"))
    m = t.embeddings.select("vec_id", ar.mono(F.array(F.slice(wide, 1, 32), F.slice(wide, 33, 32))).alias("m"))
    return rounded(m.select("vec_id", F.posexplode("m").alias("i", "x")).withColumn("i", (F.col("i") + 1).cast("long")))


@query("sc_20_multi_hot", f"SELECT vec_id, {', '.join(f'CAST(label = {k} AS INTEGER) AS is_{k}' for k in range(10))} FROM embeddings")
def one_hot(t):
    hot = t.embeddings.select("vec_id", ar.one_hot("label", range(10)).alias("h"))
    return hot.select("vec_id", *[F.col("h")[k].alias(f"is_{k}") for k in range(10)])


@query("sc_21_string_functions", "SELECT p_partkey, substr(p_name, 1, 3) AS head, lower(p_brand) AS brand, trim(p_type) AS kind, split_part(p_name, ' ', 2) AS word, lpad(CAST(p_size AS VARCHAR), 4, '0') AS size, regexp_extract(p_brand, '([0-9]+)', 1) AS num FROM part")
def strings(t):
    return t.part.select(
        "p_partkey", F.substring("p_name", 1, 3).alias("head"), F.lower("p_brand").alias("brand"), F.trim("p_type").alias("kind"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"),
    )


@query("ag_20_scale_array", "SELECT vec_id, i, round((CAST(embedding[i] AS DOUBLE) - lo) / (hi - lo + 1e-6), 6) AS x FROM (SELECT vec_id, embedding, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings), generate_series(1, 64) g(i)")
def scale_array(t):
    x = t.embeddings.select("vec_id", ar.scale_array(F.transform("embedding", lambda v: v.cast("double"))).alias("a"))
    return rounded(x.select("vec_id", F.posexplode("a").alias("i", "x")).withColumn("i", (F.col("i") + 1).cast("long")))

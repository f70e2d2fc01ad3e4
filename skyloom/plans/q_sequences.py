"""Checked queries: sequence windows, scaling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import resample as rs
from skyloom.operators import sequences as sq
from skyloom.operators import splits as sp
from skyloom.plans.q_features import RAW, rounded
from skyloom.registry import query
from skyloom.slicing import magnitude_slices, time_slices
from skyloom.functions.arrays import total
from skyloom.sources.tables import OBSD, PROBS

ORDER = ["ts", "event_id"]
W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
NUM = "num AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query("wn_14_forecast_windows", f"""WITH {NUM}, x AS (SELECT user_id, event_id, pos, n, value, {', '.join(f'lag(value, {k}) OVER w AS x{k}' for k in range(4))}, {', '.join(f'lead(value, {k}) OVER w AS y{k}' for k in (1, 2))}, hour(ts) AS h FROM num {W})
SELECT user_id, event_id, x3 AS first_x, x0 AS last_x, CAST(0 AS DOUBLE) AS pad, y1, y2, CAST(h AS DOUBLE) AS last_hour, CAST(1 AS INTEGER) AS last_mask FROM x WHERE pos >= 4 AND pos <= n - 2""")
def forecast(t):
    out = sq.forecast_windows(t.seq, ["user_id"], ORDER, ["value"], "value", 4, 2, RAW("ts"), ts_col="ts", freq="h", eval_mask=True)
    x, y = F.col("seq_x"), F.col("seq_y")
    return out.select("user_id", "event_id", x[0]["value"].alias("first_x"), x[3]["value"].alias("last_x"), x[5]["value"].alias("pad"), y[0].alias("y1"), y[1].alias("y2"), F.col("mark")[3][3].alias("last_hour"), F.col("mask")[5].alias("last_mask"))


@query("wn_15_chunk", f"WITH {NUM} SELECT user_id, CAST((pos - 1) // 8 AS BIGINT) AS chunk, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos) AS ids FROM num GROUP BY 1, 2 HAVING count(*) = 8")
def chunk(t):
    out = sq.chunk(t.seq.withColumn("v", F.col("event_id")), ["user_id"], ORDER, "v", 8, RAW("ts"))
    return out.select("user_id", "chunk", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("ids"))


@query("wn_16_next_step_pairs", f"WITH {NUM} SELECT user_id, event_id, coalesce(lag(value) OVER w, -1) AS input, value AS target FROM num {W}")
def pairs(t):
    return sq.next_step_pairs(t.seq, ["user_id"], ORDER, "value", -1.0, RAW("ts")).select("user_id", "event_id", "input", "target")


for _mode, _expr, _cond in [
    ("last", "value", "pos > n - 3"), ("first", "value", "pos <= 3"), ("pool", "avg(value) OVER (PARTITION BY user_id ORDER BY pos)", "pos > n - 3"),
    ("sum", "sum(value) OVER (PARTITION BY user_id ORDER BY pos)", "pos > n - 3"),
]:

    def _pool(t, mode=_mode):
        out = sq.pool_sequence(t.seq, ["user_id"], ORDER, "value", mode, RAW("ts"), 3)
        return rounded(out.select("user_id", "event_id", "pooled"), 8)

    query(f"wn_17_pool_{_mode}", f"WITH {NUM}, p AS (SELECT *, {_expr} AS pooled FROM num) SELECT user_id, event_id, round(pooled, 8) AS pooled FROM p WHERE {_cond}")(_pool)


@query("wn_17_pool_ragged", f"WITH {NUM} SELECT user_id, event_id, value AS pooled FROM num WHERE pos <= 5 + user_id % 7")
def pool_ragged(t):
    lengths = t.events.select("user_id").distinct().withColumn("length", F.col("user_id") % 7 + 5)
    return sq.pool_sequence(t.seq, ["user_id"], ORDER, "value", "ragged", RAW("ts"), lengths=lengths).select("user_id", "event_id", "pooled")


@query("wn_18_overlap_chunks", f"""WITH {NUM}, c AS (SELECT user_id, n, event_id, pos, unnest(generate_series((pos - 1) // 10, (pos + 1) // 10)) AS chunk FROM num)
SELECT user_id, CAST(chunk AS BIGINT) AS chunk, CASE WHEN chunk = 0 THEN '0,0,' ELSE '' END || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos) AS ids, chunk = 0 AS reset
FROM c WHERE chunk < ceil(n / 10.0) - 1 GROUP BY user_id, chunk""")
def overlap(t):
    out = sq.overlap_chunks(t.seq.withColumn("v", F.col("event_id")), ["user_id"], ORDER, "v", 10, 3, RAW("ts"))
    return out.select("user_id", "chunk", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("ids"), "reset")


@query("wn_19_ema", f"WITH {NUM} SELECT user_id, event_id, round({' + '.join(f'coalesce(lag(value, {k}) OVER w, 0) * 0.4 * pow(0.8, {k})' for k in range(6))}, 6) AS ema FROM num {W}")
def ema(t):
    return rounded(sq.ema(t.seq, ["user_id"], ORDER, "value", 0.4, 0.5, 6, RAW("ts")).select("user_id", "event_id", "ema"))


@query("wn_20_downsample_mean", f"WITH {NUM} SELECT user_id, CAST((pos - 1) // 4 AS BIGINT) AS block, round(avg(value), 6) AS value FROM num GROUP BY 1, 2 HAVING count(*) = 4")
def down_mean(t):
    return rounded(sq.downsample(t.seq, ["user_id"], ORDER, "value", 4, RAW("ts"), "mean"))


@query("wn_20_downsample_pick", f"WITH {NUM} SELECT user_id, CAST((pos - 1) // 4 AS BIGINT) AS block, value FROM num WHERE (pos - 1) % 4 = 0")
def down_pick(t):
    return sq.downsample(t.seq, ["user_id"], ORDER, "value", 4, RAW("ts"), "pick")


@query("wn_21_top_k_per_class", f"WITH {PROBS} SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(list_sum(scores), 9) DESC, vec_id) AS rn FROM probs) WHERE rn <= 5")
def top_k(t):
    return sq.top_k_per_class(t.probs.withColumn("s", F.round(total("scores"), 9)), "label", "s", 5, ["vec_id"]).select("vec_id", "label")


@query("wn_21_random_k_per_class", "SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', CAST(vec_id AS VARCHAR), '3')), vec_id) AS rn FROM embeddings) WHERE rn <= 5")
def random_k(t):
    return sq.random_k_per_class(t.embeddings.select("vec_id", "label"), "label", 5, 3, ["vec_id"])


HEX = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"


@query("wn_22_circular_shift", f"""WITH {NUM}, s AS (SELECT *, {HEX.format("concat_ws('|', CAST(user_id AS VARCHAR), '5')")} % n AS shift FROM num)
SELECT user_id, event_id, (pos - 1 - shift + n) % n AS shifted_pos FROM s""")
def roll(t):
    return sq.circular_shift(t.seq, ["user_id"], ORDER, 5, RAW("ts")).select("user_id", "event_id", "shifted_pos")


@query("sc_19_drop_points", f"""WITH p AS (SELECT event_id, value, {HEX.format("concat_ws('|', CAST(event_id AS VARCHAR), 'value', '9')")} / CAST(4294967296 AS DOUBLE) >= 0.3 AS present FROM events)
SELECT event_id, CASE WHEN present THEN value ELSE 0 END AS value, CAST(present AS INTEGER) AS value_present FROM p""")
def drop_points(t):
    return sq.drop_points(t.events.select("event_id", "value"), ["event_id"], ["value"], 0.3, 9)


@query("ag_19a_standard_scaler", f"""WITH {OBSD}, s AS (SELECT avg(precip) AS pm, stddev_pop(precip) AS ps, avg(temp) AS tm, stddev_pop(temp) AS ts FROM obsd WHERE datetime < TIMESTAMP '2000-01-01')
SELECT stationid, datetime, round((precip - pm) / ps, 6) AS precip, round((temp - tm) / ts, 6) AS temp FROM obsd, s""")
def scaler(t):
    stats = sq.fit_scaler(t.obsd, ["precip", "temp"], "datetime < '2000-01-01'")
    return rounded(sq.scale(t.obsd, ["precip", "temp"], stats))


@query("ag_19a_inverse", f"WITH {OBSD} SELECT stationid, datetime, round(precip, 6) AS precip, round(temp, 6) AS temp FROM obsd")
def inverse(t):
    stats = sq.fit_scaler(t.obsd, ["precip", "temp"], "datetime < '2000-01-01'")
    return rounded(sq.unscale(sq.scale(t.obsd, ["precip", "temp"], stats), ["precip", "temp"], stats))


@query("ag_19b_channel_normalise", f"""WITH {OBSD}, s AS (SELECT avg(precip) AS pm, stddev_samp(precip) AS ps FROM obsd WHERE datetime < TIMESTAMP '2000-01-01')
SELECT stationid, datetime, round((precip - pm) / (ps + 1e-5), 6) AS precip FROM obsd, s""")
def channel(t):
    df = t.obsd.drop("temp")
    return rounded(sq.scale(df, ["precip"], sq.fit_scaler(df, ["precip"], "datetime < '2000-01-01'", ddof=1), 1e-5))


@query("ag_19c_global_scaler", """WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT avg(x) AS m, stddev_pop(x) AS d FROM e WHERE label < 7)
SELECT vec_id, i, round((x - m) / d, 5) + 0 AS x FROM e, s""")
def global_scaler(t):
    df = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    out = sq.scale_arrays(df, "a", sq.fit_global_scaler(df, "a", "label < 7"))
    return rounded(out.select("vec_id", F.posexplode("a").alias("i", "x")).withColumn("i", (F.col("i") + 1).cast("long")), 5)


@query("ag_20_minmax", "SELECT user_id, event_id, round(-1 + 2 * (value - min(value) OVER p) / (max(value) OVER p - min(value) OVER p + 1e-6), 6) AS value FROM events WINDOW p AS (PARTITION BY user_id)")
def minmax(t):
    return rounded(sq.minmax(t.events.select("user_id", "event_id", "value"), ["user_id"], "value", -1.0, 1.0))


# --- splits --------------------------------------------------------------------------------------------------------
def hashed(table, key, seed, part=""):
    return f"h AS (SELECT *, row_number() OVER ({part} ORDER BY md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}')), {key}) AS no, count(*) OVER ({part}) AS n FROM {table})"


@query("sp_01_split_random", f"WITH {hashed('documents', 'doc_id', 11)} SELECT doc_id, CASE WHEN no <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN no <= floor(n * 0.7 + 1e-9) + floor(n * 0.15 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM h")
def split_random(t):
    return sp.split_random(t.documents.select("doc_id"), (0.7, 0.15, 0.15), ["doc_id"], 11)


SERIES = f"{OBSD}, d AS (SELECT datetime, sum(precip) AS precip FROM obsd GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY datetime) AS no, count(*) OVER () AS n FROM d)"


def series(t):
    return rs.consolidate(t.obsd, "datetime", ["precip"], "sum")


def years():
    return time_slices("datetime", "year")


@query("sp_02_split_time_newest_test", f"WITH {SERIES} SELECT datetime, precip, CASE WHEN n - no + 1 <= floor(n * 0.2 + 1e-9) THEN 'test' WHEN n - no + 1 <= floor(n * 0.2 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'val' ELSE 'train' END AS split FROM o")
def split_newest(t):
    return sp.split_time(series(t), ["datetime"], (0.7, 0.1, 0.2), years(), oldest="rest")


@query("sp_03_split_time_oldest_train", f"WITH {SERIES} SELECT datetime, precip, CASE WHEN no <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN no <= floor(n * 0.7 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM o")
def split_oldest(t):
    return sp.split_time(series(t), ["datetime"], (0.7, 0.1, 0.2), years())


@query("sp_04_split_borders", f"""WITH {SERIES}, b AS (SELECT datetime, no - 1 AS at_no, CAST(floor(n * 0.7 + 1e-9) AS BIGINT) AS a, CAST(floor(n * 0.2 + 1e-9) AS BIGINT) AS c, n FROM o)
SELECT datetime, 'train' AS split FROM b WHERE at_no < a UNION ALL SELECT datetime, 'val' FROM b WHERE at_no >= a - 30 AND at_no < n - c UNION ALL SELECT datetime, 'test' FROM b WHERE at_no >= n - c - 30""")
def borders(t):
    return sp.split_borders(series(t), ["datetime"], years(), 30).drop("precip")


@query("sp_04_split_borders_fixed", f"""WITH {SERIES} SELECT datetime, 'train' AS split FROM o WHERE no <= 360 UNION ALL SELECT datetime, 'val' FROM o WHERE no > 360 - 24 AND no <= 480 UNION ALL SELECT datetime, 'test' FROM o WHERE no > 480 - 24 AND no <= 600""")
def borders_fixed(t):
    return sp.split_borders(series(t), ["datetime"], years(), 24, lengths=(360, 120, 120)).drop("precip")


@query("sp_05_split_stratified", f"WITH {hashed('documents', 'doc_id', 2, 'PARTITION BY lang')} SELECT doc_id, lang, CASE WHEN no <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN no <= floor(n * 0.7 + 1e-9) + floor(n * 0.15 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM h")
def stratified(t):
    return sp.split_stratified(t.documents.select("doc_id", "lang"), "lang", (0.7, 0.15, 0.15), ["doc_id"], 2)


@query("sp_06_split_fold", "SELECT doc_id, CASE WHEN doc_id % 10 + 1 = 9 THEN 'val' WHEN doc_id % 10 + 1 = 10 THEN 'test' ELSE 'train' END AS split FROM documents")
def fold(t):
    return sp.split_fold(t.documents.select("doc_id", (F.col("doc_id") % 10 + 1).alias("fold")), "fold").drop("fold")


@query("sp_07_split_ranges", """WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS no, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN no <= floor(n * 0.88 + 1e-9) THEN 'train' WHEN no <= floor(n * 0.88 + 1e-9) + floor((n - floor(n * 0.88 + 1e-9)) / 2) THEN 'val' ELSE 'test' END AS split FROM h""")
def ranges(t):
    return sp.split_ranges(t.documents.select("doc_id"), ["doc_id"], magnitude_slices("doc_id"), 0.88)


@query("sp_08_split_lists", """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'test' WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'val' ELSE 'train' END AS split FROM documents""")
def lists(t):
    return sp.split_lists(t.documents.select("doc_id"), "doc_id", t.labels.where("quality = 0").select("doc_id"), t.labels.where("toxic = 1").select("doc_id"))


@query("sp_09_split_train_val", f"WITH {hashed('documents', 'doc_id', 4)} SELECT doc_id, CASE WHEN no <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'val' END AS split FROM h")
def train_val(t):
    return sp.split_train_val(t.documents.select("doc_id"), 0.2, ["doc_id"], 4)


@query("sp_10_split_two_step", f"WITH {hashed('documents', 'doc_id', 6)} SELECT doc_id, CASE WHEN no <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN no <= floor(n * 0.7 + 1e-9) + floor((n - floor(n * 0.7 + 1e-9)) / 2) THEN 'val' ELSE 'test' END AS split FROM h")
def two_step(t):
    return sp.split_two_step(t.documents.select("doc_id"), ["doc_id"], 6)


@query("sp_10_split_tail", f"WITH {SERIES} SELECT datetime, CASE WHEN no > n - floor(n / 7.0 + 1e-9) THEN 'val' ELSE 'train' END AS split FROM o")
def tail(t):
    return sp.split_tail(series(t), ["datetime"], years()).drop("precip")


@query("sp_11_split_half", f"WITH {hashed('embeddings', 'vec_id', 8)} SELECT vec_id, CASE WHEN no <= floor(n * 0.5 + 1e-9) THEN 'tune' ELSE 'measure' END AS split FROM h")
def half(t):
    return sp.split_half(t.embeddings.select("vec_id"), ["vec_id"], 8)

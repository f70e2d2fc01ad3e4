"""Checked queries: unions, semi-joins, label maps, melting, weights and reproducible order."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import reshape as rh
from skyloom.plans.q_features import rounded
from skyloom.registry import query
from skyloom.sources.tables import OBSD, OBSH


@query("set_01_union_tagged", "SELECT l_orderkey AS id, l_quantity AS qty, CAST(NULL AS DOUBLE) AS price, 'items' AS src FROM lineitem UNION ALL SELECT o_orderkey, NULL, o_totalprice, 'orders' FROM orders")
def union_tagged(t):
    a = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("qty"))
    b = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return rh.union_tagged({"items": a, "orders": b}, "src")


@query("set_02_distinct_keys", "SELECT l_shipdate AS d FROM lineitem UNION SELECT o_orderdate FROM orders")
def distinct_keys(t):
    return rh.distinct_keys([t.lineitem.select(F.col("l_shipdate").alias("d")), t.orders.select(F.col("o_orderdate").alias("d"))], "d")


@query("set_03_keep_labels", """SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS kept FROM orders GROUP BY 1""")
def keep_labels(t):
    sets = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("labels"))
    return rh.keep_labels(sets, "labels", ["1-URGENT", "2-HIGH"]).select("o_custkey", F.size("labels").cast("long").alias("kept"))


@query("set_04_drop_in", "SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def drop_in(t):
    return rh.drop_in(t.customer.select("c_custkey").distinct(), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("jn_10_semi", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return rh.keep_in(t.customer, done, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("jn_10_anti", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti(t):
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return rh.drop_in(t.customer, done, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("set_06_melt_answers", """SELECT l_orderkey, l_linenumber, l_partkey, r AS recording, CASE r WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice ELSE l_tax END AS quality,
 CASE r WHEN 0 THEN l_discount WHEN 1 THEN l_tax ELSE l_quantity END AS digit FROM lineitem, (VALUES (0), (1), (2)) v(r)""")
def melt_answers(t):
    wide = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("recording_0_quality"), F.col("l_discount").alias("recording_0_digit"),
        F.col("l_extendedprice").alias("recording_1_quality"), F.col("l_tax").alias("recording_1_digit"), F.col("l_tax").alias("recording_2_quality"), F.col("l_quantity").alias("recording_2_digit"),
    )
    return rh.melt_answers(wide, ["l_orderkey", "l_linenumber", "l_partkey"], range(3), ["quality", "digit"])


@query("set_08_pivot_stations", f"""WITH {OBSH} SELECT datetime, {', '.join(f'''round(max(precip) FILTER (stationid = '{s}'), 6) AS "{s}_precip", max(n) FILTER (stationid = '{s}') AS "{s}_n"''' for s in '013')}
FROM obsh WHERE stationid IN ('0', '1', '3') GROUP BY 1""")
def pivot_stations(t):
    return rounded(rh.pivot_stations(t.obsh, ["0", "1", "3"], ["precip", "n"]))


@query("jn_12_join_ratings", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity AS quality, o.o_orderstatus AS method, c.c_mktsegment AS label FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_ratings(t):
    responses = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("uid"), F.col("l_quantity").alias("quality"))
    uids = t.orders.select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("filename"), F.col("o_orderstatus").alias("method"))
    classes = t.customer.select(F.col("c_custkey").alias("filename"), F.col("c_mktsegment").alias("label"))
    return rh.join_ratings(responses, uids, classes).select("l_orderkey", "l_linenumber", "l_partkey", "quality", "method", "label")


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
CODES = f"""codes AS (SELECT user_id, {K} AS k, max(value) AS w FROM events GROUP BY 1, 2),
 classes AS (SELECT DISTINCT {K} AS k, CASE WHEN {K} % 3 <> 0 THEN 1 ELSE 0 END AS diagnostic, CASE WHEN {K} % 4 = 0 THEN 1 ELSE 0 END AS form, {K} % 2 AS rhythm,
  'c' || CAST({K} % 5 AS VARCHAR) AS class, CASE WHEN {K} % 7 <> 0 THEN 's' || CAST({K} % 11 AS VARCHAR) END AS subclass FROM events)"""


def code_parts(t):
    k = F.get_json_object("props", "$.k").cast("int")
    codes = t.events.groupBy("user_id", k.alias("k")).agg(F.max("value").alias("w"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("k"), F.col("w"))))  # one pair per distinct code
    entries = F.transform(pairs, lambda p: F.struct(p["k"].cast("string").alias("key"), p["w"].alias("value")))
    records = codes.groupBy("user_id").agg(F.map_from_entries(entries).alias("codes"))
    c = F.col("k")
    classes = t.events.select(k.alias("k")).distinct().select(
        c.cast("string").alias("code"), (c % 3 != 0).cast("int").alias("diagnostic"), (c % 4 == 0).cast("int").alias("form"), (c % 2).alias("rhythm"),
        F.concat(F.lit("c"), (c % 5).cast("string")).alias("class"), F.when(c % 7 != 0, F.concat(F.lit("s"), (c % 11).cast("string"))).alias("subclass"),
    )
    return records, classes


for _mode, _label, _flag in [
    ("diagnostic", "CAST(c.k AS VARCHAR)", "diagnostic"), ("subdiagnostic", "subclass", "diagnostic"), ("superdiagnostic", "class", "diagnostic"),
    ("form", "CAST(c.k AS VARCHAR)", "form"), ("rhythm", "CAST(c.k AS VARCHAR)", "rhythm"), ("all", None, None),
]:
    if _mode == "all":
        _sql = f"WITH {CODES} SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS target FROM codes GROUP BY 1"
    else:
        _sql = f"""WITH {CODES}, hit AS (SELECT DISTINCT user_id, {_label} AS label FROM codes c JOIN classes USING (k) WHERE {_flag} = 1)
SELECT u.user_id, coalesce(string_agg(label, ',' ORDER BY label), '') AS target FROM (SELECT DISTINCT user_id FROM codes) u LEFT JOIN hit h ON h.user_id = u.user_id GROUP BY 1"""

    def _map(t, mode=_mode):
        records, classes = code_parts(t)
        out = rh.map_codes(records, ["user_id"], "codes", classes, mode)
        return out.select("user_id", F.array_join("target", ",").alias("target"))

    query(f"jn_13_map_codes_{_mode}", _sql)(_map)


@query("jn_13_map_codes_best", f"""WITH {CODES}, hit AS (SELECT user_id, class, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, k) AS rn FROM codes JOIN classes USING (k) WHERE diagnostic = 1)
SELECT u.user_id, coalesce(class, '') AS target FROM (SELECT DISTINCT user_id FROM codes) u LEFT JOIN hit h ON h.user_id = u.user_id AND rn = 1""")
def map_best(t):
    records, classes = code_parts(t)
    return rh.map_codes(records, ["user_id"], "codes", classes, "superdiagnostic_multiclass")


@query("ag_16_inverse_frequency", "SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS class_count, round(1.0 / count(*) OVER (PARTITION BY lang), 8) AS weight FROM documents")
def inverse_frequency(t):
    return rounded(rh.inverse_frequency(t.documents.select("doc_id", "lang"), "lang"), 8)


def _part(salt):
    return f"CAST(('0x' || substr(md5(concat_ws('|', CAST(draw AS VARCHAR), '7-{salt}')), 1, 12)) AS BIGINT)"


@query("ag_17_balanced_sample", f"""WITH z AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '7')), doc_id) AS no, count(*) OVER (PARTITION BY lang) AS size FROM documents),
 c AS (SELECT lang, size, row_number() OVER (ORDER BY lang) - 1 AS c, count(*) OVER () AS k FROM (SELECT DISTINCT lang, size FROM z)),
 w AS (SELECT draw, {_part('class')} % (SELECT max(k) FROM c) AS c, {_part('row')} AS r FROM generate_series(0, 4999) g(draw))
SELECT w.draw, z.doc_id, z.lang FROM w JOIN c ON c.c = w.c JOIN z ON z.lang = c.lang AND z.no = w.r % c.size + 1""")
def balanced(t):
    return rh.balanced_sample(t.documents.select("doc_id", "lang"), "lang", 5000, 7, ["doc_id"])


@query("ag_18_filter_rare_labels", f"""WITH {CODES}, n AS (SELECT k FROM codes GROUP BY 1 HAVING count(*) > 75)
SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS target FROM codes WHERE k IN (SELECT k FROM n) GROUP BY 1""")
def rare(t):
    records, _ = code_parts(t)
    labels = records.select("user_id", F.map_keys("codes").alias("target"))
    out = rh.filter_rare_labels(labels, ["user_id"], "target", 75)
    return out.select("user_id", F.array_join("target", ",").alias("target"))


@query("st_05_seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id) AS pos FROM documents")
def shuffle(t):
    return rh.seeded_positions(t.documents.select("doc_id"), ["doc_id"], 42)


@query("st_06_natural_order", "SELECT p_partkey, p_brand FROM part ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), p_brand")
def natural(t):
    return rh.natural_order(t.part.select("p_partkey", "p_brand"), "p_brand")


@query("pf_25_select_split_attrs", """SELECT c_custkey, (CASE WHEN c_acctbal > 0 THEN 1 ELSE -1 END + 1) // 2 AS attr, c_mktsegment FROM customer WHERE c_nationkey % 3 = 1""")
def split_attrs(t):
    meta = t.customer.select("c_custkey", (F.col("c_nationkey") % 3).alias("split"), F.when(F.col("c_acctbal") > 0, 1).otherwise(-1).alias("attr"), "c_mktsegment")
    return rh.select_split_attrs(meta, ["attr"], "split", 1).select("c_custkey", "attr", "c_mktsegment")

"""Checked queries: station search, neighbour pairs, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators import stations as st
from skyloom.plans.q_features import rounded
from skyloom.registry import query
from skyloom.sources.tables import STN


def hav(a, b, c, d, r):
    s = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"(2 * {r} * asin(sqrt(least(1.0, {s}))))"


def bear(a, b, c, d):
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return f"fmod(degrees(atan2({y}, {x})) + 360, 360)"


HERE = ("CAST(40.0 AS DOUBLE)", "CAST(-100.0 AS DOUBLE)")


@query("sc_01_haversine", f"WITH {STN} SELECT stid, round({hav(*HERE, 'latitude', 'longitude', 3958.8)}, 6) AS miles FROM stations")
def haversine(t):
    return t.stations.select("stid", F.round(geo.haversine(F.lit(40.0), F.lit(-100.0), "latitude", "longitude"), 6).alias("miles"))


@query("sc_02_bearing", f"WITH {STN} SELECT stid, round({bear(*HERE, 'latitude', 'longitude')}, 6) AS bearing FROM stations")
def bearing(t):
    return t.stations.select("stid", F.round(geo.bearing(F.lit(40.0), F.lit(-100.0), "latitude", "longitude"), 6).alias("bearing"))


@query("sc_03_degree_distance", f"WITH {STN} SELECT stid, round(sqrt(pow(latitude - 40, 2) + pow(longitude + 100, 2)), 6) AS degrees FROM stations")
def degrees(t):
    return t.stations.select("stid", F.round(geo.degree_distance(F.lit(40.0), F.lit(-100.0), "latitude", "longitude"), 6).alias("degrees"))


@query("sc_04_width_bin", "SELECT event_id, CASE WHEN value > 0 THEN CAST(ceil(value / 0.5) AS BIGINT) END AS bkt FROM events")
def width_bin(t):
    return t.events.select("event_id", geo.width_bin("value", 0.5).alias("bkt"))


@query("jn_01_find_nearest", f"""WITH {STN}, p AS (SELECT latitude AS a, longitude AS b FROM stations WHERE stid = '7'),
 d AS (SELECT s.*, {hav('a', 'b', 'latitude', 'longitude', 3958.8)} AS m FROM stations s, p)
SELECT stid, s_name, round(m, 6) AS distance_miles FROM d WHERE m <= 900 ORDER BY m, stid LIMIT 25""")
def find_nearest(t):
    out = st.find_nearest(t.stations, station_id="7", n_miles=900, max_stations=25)
    return rounded(out.select("stid", "s_name", "distance_miles"))


@query("jn_01_find_nearest_point", f"""WITH {STN}, d AS (SELECT s.*, {hav(*HERE, 'latitude', 'longitude', 3958.8)} AS m FROM stations s)
SELECT stid, round(m, 6) AS distance_miles FROM d WHERE latitude >= 40 AND longitude <= -100 ORDER BY m, stid""")
def nearest_point(t):
    return rounded(st.find_nearest(t.stations, latitude=40.0, longitude=-100.0, direction="NW").select("stid", "distance_miles"))


@query("jn_02_station_pairs_km", f"""WITH {STN}, d AS (SELECT a.stid AS tgt_stid, b.stid AS feat_stid, {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude', 6371.0)} AS distance,
 {bear('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS bearing FROM stations a, stations b)
SELECT tgt_stid, feat_stid, round(distance, 5) AS distance, round(bearing, 5) AS bearing FROM d WHERE distance <= 400""")
def pairs_km(t):
    near = st.station_pairs(t.stations, 400.0)
    return near.withColumns({c: geo.rounded(c, 5) for c in ("distance", "bearing")})


DEG = f"""{STN}, near AS (SELECT a.stid AS tgt_stid, b.stid AS feat_stid, sqrt(pow(b.latitude - a.latitude, 2) + pow(b.longitude - a.longitude, 2)) AS distance,
 {bear('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS bearing FROM stations a, stations b),
 pairs AS (SELECT *, CASE WHEN distance > 0 THEN CAST(ceil(distance / 0.5) AS BIGINT) END AS vect_close_bkt, CASE WHEN bearing > 0 THEN CAST(ceil(bearing / 30) AS BIGINT) END AS bearing_bkt
  FROM near WHERE distance < 4)"""


@query("jn_02_station_pairs_degree", f"WITH {DEG} SELECT tgt_stid, feat_stid, vect_close_bkt, bearing_bkt FROM pairs")
def pairs_degree(t):
    return st.add_buckets(st.station_pairs(t.stations, 4.0, "degree")).drop("distance", "bearing")


@query("jn_03a_filter_quadrant", f"WITH {STN} SELECT stid FROM stations WHERE latitude <= 40 AND longitude >= -100")
def quadrant(t):
    return st.filter_quadrant(t.stations, 40.0, -100.0, "SE").select("stid")


@query("jn_03b_filter_compass", f"WITH {STN}, b AS (SELECT stid, {bear(*HERE, 'latitude', 'longitude')} AS b FROM stations) SELECT stid, 'N' AS dir FROM b WHERE b >= 348.75 OR b < 11.25 UNION ALL SELECT stid, 'ESE' FROM b WHERE b BETWEEN 101.25 AND 123.75")
def compass(t):
    b = t.stations.withColumn("b", geo.bearing(F.lit(40.0), F.lit(-100.0), "latitude", "longitude"))
    part = lambda d: st.filter_compass(b, "b", d).select("stid", F.lit(d).alias("dir"))
    return part("N").union(part("ESE"))


@query("jn_03c_find_stations", f"""WITH {STN}, d AS (SELECT s.*, {hav(*HERE, 'latitude', 'longitude', 3959)} AS m, {bear(*HERE, 'latitude', 'longitude')} AS b FROM stations s)
SELECT stid, latitude, longitude, round(m, 2) AS distance, round(b, 2) AS bearing FROM d WHERE m <= 1500 AND b BETWEEN 258.75 AND 281.25""")
def find_stations(t):
    return st.find_stations(t.stations, latitude=40.0, longitude=-100.0, distance=1500, direction="W")


@query("jn_11_stations_with_all", """SELECT l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3""")
def with_all(t):
    return st.stations_with_all(t.lineitem, "l_suppkey", "l_returnflag", ["A", "N", "R"])


@query("wn_10_rank_neighbours", f"""WITH {DEG}, r AS (SELECT *, coalesce(vect_close_bkt + 1, 1) AS bucket_rank FROM pairs)
SELECT tgt_stid, feat_stid, bucket_rank, dense_rank() OVER (PARTITION BY tgt_stid ORDER BY bucket_rank, feat_stid) AS rank FROM r""")
def rank(t):
    near = st.add_buckets(st.station_pairs(t.stations, 4.0, "degree"))
    return st.rank_neighbours(near).select("tgt_stid", "feat_stid", "bucket_rank", F.col("rank").cast("long").alias("rank"))


@query("st_03_nearest_k", f"""WITH {STN} SELECT stid, round({hav(*HERE, 'latitude', 'longitude', 3958.8)}, 6) AS distance_miles FROM stations ORDER BY {hav(*HERE, 'latitude', 'longitude', 3958.8)}, stid LIMIT 10""")
def nearest_k(t):
    return rounded(st.find_nearest(t.stations, latitude=40.0, longitude=-100.0, max_stations=10).select("stid", "distance_miles"))


@query("st_04_order_neighbours", f"WITH {DEG} SELECT tgt_stid, feat_stid, CASE WHEN distance > 0 THEN round(distance, 6) END AS distance FROM pairs")
def order(t):
    near = st.station_pairs(t.stations, 4.0, "degree")
    near = near.select("tgt_stid", "feat_stid", F.when(F.col("distance") > 0, geo.rounded("distance", 6)).alias("distance"))
    return st.order_neighbours(near, ties=["tgt_stid", "feat_stid"])


@query("st_07_cap_per_target", f"""WITH {DEG} SELECT tgt_stid, feat_stid FROM (SELECT *, row_number() OVER (PARTITION BY tgt_stid ORDER BY round(distance, 6), feat_stid) AS rn FROM pairs) WHERE rn <= 3""")
def cap(t):
    near = st.station_pairs(t.stations, 4.0, "degree", nearest=3)
    return st.cap_per_target(near, "tgt_stid", [geo.rounded("distance", 6), "feat_stid"], 3).select("tgt_stid", "feat_stid")


@query("pl_07_target_neighbour_list", f"""WITH {DEG}, own AS (SELECT CAST(l_suppkey AS VARCHAR) AS stid FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2),
 r AS (SELECT *, coalesce(vect_close_bkt + 1, 1) AS bucket_rank FROM pairs WHERE feat_stid IN (SELECT stid FROM own))
SELECT tgt_stid, feat_stid, vect_close_bkt, bearing_bkt, dense_rank() OVER (PARTITION BY tgt_stid ORDER BY bucket_rank, feat_stid) AS rank FROM r""")
def neighbour_list(t):
    metrics = t.lineitem.select(F.col("l_suppkey").cast("string").alias("stid"), F.col("l_returnflag").alias("metric"))
    out = st.target_neighbour_list(t.stations, metrics, ["A", "R"], 4.0)
    return out.select("tgt_stid", "feat_stid", "vect_close_bkt", "bearing_bkt", F.col("rank").cast("long").alias("rank"))

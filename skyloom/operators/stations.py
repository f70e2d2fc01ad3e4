"""Station search: nearest stations, direction filters, neighbour pairs and their ranking."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.functions.geo import EARTH_KM, EARTH_MILES, bearing, degree_distance, half_chord_square, haversine, width_bin

logger = logging.getLogger(__name__)

# fixed values: sign of the latitude and longitude step of each quadrant direction
QUADRANTS = {"N": (1, 0), "S": (-1, 0), "E": (0, 1), "W": (0, -1), "NE": (1, 1), "NW": (1, -1), "SE": (-1, 1), "SW": (-1, -1)}
# fixed values: the sixteen compass sectors clockwise from north, each 22.5 degrees wide
SECTORS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
SECTOR_WIDTH = 22.5
FINDER_MILES = 3959.0


def filter_quadrant(df: DataFrame, lat: float, lon: float, direction: str | None) -> DataFrame:
    """Rows on the given side of the point, borders included; an unknown direction filters nothing."""
    d_lat, d_lon = QUADRANTS.get((direction or "").upper(), (0, 0))
    keep = F.lit(True)
    if d_lat:
        keep &= F.col("latitude") >= lat if d_lat > 0 else F.col("latitude") <= lat
    if d_lon:
        keep &= F.col("longitude") >= lon if d_lon > 0 else F.col("longitude") <= lon
    return df.where(keep)


def in_sector(bearing_col, direction: str) -> Column:
    b = F.col(bearing_col) if isinstance(bearing_col, str) else bearing_col
    name = direction.upper()
    if name not in SECTORS:
        if name != "RADIUS":
            logger.warning("unknown direction %r; all directions kept", direction)
        return F.lit(True)
    mid = SECTORS.index(name) * SECTOR_WIDTH
    low, high = mid - SECTOR_WIDTH / 2, mid + SECTOR_WIDTH / 2
    return (b >= low + 360) | (b < high) if low < 0 else (b >= low) & (b <= high)


def filter_compass(df: DataFrame, bearing_col: str, direction: str) -> DataFrame:
    return df.where(in_sector(bearing_col, direction))


def _near_box(lat: float, lon: float, miles: float, radius: float) -> Column:
    """Bounding box around the circle: plain comparisons that reach the file scan."""
    reach = miles / radius
    d_lat = math.degrees(reach) * 1.0001 + 1e-9
    box = F.col("latitude").between(lat - d_lat, lat + d_lat)
    if abs(lat) + d_lat < 89.9:
        d_lon = math.degrees(math.asin(min(1.0, math.sin(min(reach, math.pi / 2)) / math.cos(math.radians(lat))))) * 1.0001 + 1e-9
        if lon - d_lon > -180 and lon + d_lon < 180:
            box &= F.col("longitude").between(lon - d_lon, lon + d_lon)
    return box


def _point(stations: DataFrame, station_id: str) -> tuple[float, float] | None:
    row = stations.where(F.col("stid").cast("string") == str(station_id)).select("latitude", "longitude").head(1)
    return (float(row[0][0]), float(row[0][1])) if row else None


def find_nearest(
    stations: DataFrame,
    station_id: str | None = None,
    latitude: float | None = None,
    longitude: float | None = None,
    n_miles: float = 0.0,
    max_stations: int | None = None,
    direction: str | None = None,
) -> DataFrame:
    """Stations by distance from a station or a point; ties by id. No radius with a point means no limit."""
    if station_id is not None:
        point = _point(stations, station_id)
        if point is None:
            logger.warning("station %s not found", station_id)
            return stations.withColumn("distance_miles", F.lit(0.0)).limit(0)
        latitude, longitude = point
        if n_miles == 0:
            own = stations.where(F.col("stid").cast("string") == str(station_id))
            return own.withColumn("distance_miles", F.lit(0.0)).limit(1)
    if latitude is None or longitude is None:
        raise ValueError("a station id or both latitude and longitude are needed")
    found = stations
    if n_miles > 0:
        found = found.where(_near_box(latitude, longitude, n_miles, EARTH_MILES))
    found = found.withColumn("distance_miles", haversine(F.lit(latitude), F.lit(longitude), "latitude", "longitude"))
    if n_miles > 0:
        found = found.where(F.col("distance_miles") <= n_miles)
    if direction:
        found = filter_quadrant(found, latitude, longitude, direction)
    found = found.orderBy("distance_miles", "stid")
    return found if max_stations is None else found.limit(max_stations)


def find_stations(
    stations: DataFrame, stid: str | None = None, latitude: float | None = None, longitude: float | None = None,
    distance: float = 100.0, direction: str = "RADIUS",
) -> DataFrame:
    """Stations within a distance and compass sector, with distance and bearing rounded to two places."""
    if stid is not None:
        point = _point(stations, stid)
        if point is None:
            raise ValueError(f"station {stid} not found")
        latitude, longitude = point
    elif latitude is None or longitude is None:
        raise ValueError("a station id or both latitude and longitude are needed")
    if distance <= 0:
        raise ValueError("distance must be positive")
    here = (F.lit(latitude), F.lit(longitude))
    near = stations.where(_near_box(latitude, longitude, distance, FINDER_MILES)).withColumns(
        {"_d": haversine(*here, "latitude", "longitude", FINDER_MILES, "asin"), "_b": bearing(*here, "latitude", "longitude")}
    ).where((F.col("_d") <= distance) & in_sector("_b", direction))
    return near.select(
        "stid", "latitude", "longitude", F.round("_d", 2).alias("distance"), F.round("_b", 2).alias("bearing")
    ).orderBy("distance", "stid")


def _cells(lat_cell: float, band: Column) -> Column:
    """Number of longitude cells in a latitude band: fewer towards the poles, so that no cell gets too narrow."""
    edge = F.greatest(F.abs(band), F.abs(band + 1)) * lat_cell
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / lat_cell)).cast("int")


#: Fixed value: cells across a radius. More of them leave fewer pairs to measure, and copy each target to more cells.
CUT = 3
#: Parts of the targets for each task that runs at once, at least, and targets of a part, about, at most.
TASKS, TARGETS = 8, 256
#: Fixed value: rows of stations up to which they are sent to all targets (about 50 MB), which then stay in their parts.
SENT = 500_000
#: Distances this close count as equal where only the nearest are wanted, and at most so many halvings of cells.
TIE = 1e-5
HALVINGS = 24


def _flat_cells(radius: float, reach: Column | float, level: Column | None = None):
    """Band and place of a point, and the lists of bands and places that a circle of ``reach`` touches, on a flat map.

    Cells are ``radius`` wide, halved ``level`` times.
    """
    scale = F.lit(1.0) if level is None else F.pow(F.lit(2.0), level)
    at = lambda x: F.floor(x / radius * scale)
    reach = reach if isinstance(reach, Column) else F.lit(reach)
    pad = lambda lat, lon: reach * (1 + 1e-9) + (F.abs(lat) + F.abs(lon) + 1) * 1e-15  # over the rounding of what follows

    def places(lat, lon, band):
        away = F.greatest(F.lit(0.0), band / scale * radius - lat, lat - (band + 1) / scale * radius)
        half = F.sqrt(F.greatest(F.lit(0.0), F.pow(pad(lat, lon), 2) - F.pow(away, 2))) + (F.abs(lon) + 1) * 1e-15
        return F.sequence(at(lon - half), at(lon + half))

    return at, lambda lat, lon: F.sequence(at(lat - pad(lat, lon)), at(lat + pad(lat, lon))), places


def _globe_cells(radius: float):
    """The same on the globe for ``radius`` in km: bands of a ``CUT``-th of the radius, cut into cells about as wide."""
    turn = radius / EARTH_KM * 1.0001 + 1e-7  # over the rounding of what follows
    size = math.degrees(turn) / CUT
    count = lambda band: _cells(size, band)
    place = lambda lon, n: F.floor((lon + 180) / 360 * n).cast("long")
    band_of = lambda lat: F.floor(lat / size)

    def places(lat, lon, band):
        n = count(band)
        every = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
        if turn > 1.5:  # a quarter of the globe
            return every
        # within the band the circle is widest at this latitude, or as close to it as the band comes
        widest = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(F.radians(lat)) / math.cos(turn)))))
        p, q = F.radians(lat), F.radians(F.greatest(band * size, F.least((band + 1) * size, widest)))
        cosine = (math.cos(turn) - F.sin(p) * F.sin(q)) / F.greatest(F.cos(p) * F.cos(q), F.lit(1e-300))
        half = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) + 1e-9
        some = F.array_distinct(F.transform(F.sequence(place(lon - half, n), place(lon + half, n)), lambda c: F.pmod(c, n)))
        return F.when((cosine <= -1) | (F.abs(lat) > 90), every).otherwise(some)

    return (
        lambda lat, lon: (band_of(lat), F.pmod(place(lon, count(band_of(lat))), count(band_of(lat)))),
        lambda lat, lon: F.sequence(band_of(lat - math.degrees(turn)), band_of(lat + math.degrees(turn))),
        places,
    )


def _spread(tgt: DataFrame, rows: int) -> DataFrame:
    """Targets in parts by id. A small file is one task, its pairs are not; few targets in a part leave few pairs to sort."""
    spark = tgt.sparkSession
    at_once = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tgt.repartition(max(TASKS * at_once, math.ceil(rows / TARGETS)), "tgt_stid")


def station_pairs(
    stations: DataFrame, radius: float, unit: str = "km", targets: DataFrame | None = None, nearest: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """(tgt_stid, feat_stid, distance, bearing) of all stations within ``radius``, a station being its own neighbour.

    ``unit`` is ``km`` (great circle, ``<=``) or ``degree`` (flat, ``<``). Points meet through grid cells: a target is
    copied to the cells its circle touches, joined on the cell, then the exact distance decides. What depends on one of
    the two stations only is computed before they meet. ``most`` is a bound of the number of stations, where to count
    them is dear.

    With ``nearest`` (for ``degree``) a target's pairs may be left out where at least so many others come before them by
    distance, even by one rounded to ``TIE`` or finer, then ``feat_stid``: ``cap_per_target`` finds the same rows in
    what remains, and the work does not grow with the number of stations within the radius.
    """
    if unit not in ("km", "degree"):
        raise ValueError("unit is 'km' or 'degree'")
    great = unit == "km"
    if nearest is not None and (great or nearest < 1):
        raise ValueError("nearest is a positive number, for unit 'degree'")
    lat, lon = F.col("latitude"), F.col("longitude")
    points = stations.where(lat.isNotNull() & lon.isNotNull())
    trig = lambda side: [f(F.radians(lat)).alias(f"{side}_{f.__name__}") for f in (F.sin, F.cos)]
    feats = points.select(F.col("stid").alias("feat_stid"), lat.alias("f_lat"), lon.alias("f_lon"), *trig("f"))
    tgt = (targets if targets is not None else points).where(lat.isNotNull() & lon.isNotNull()).select(
        F.col("stid").alias("tgt_stid"), lat.alias("t_lat"), lon.alias("t_lon"), *trig("t")
    )
    known = ["t_sin", "t_cos", "f_sin", "f_cos"]
    if nearest is not None:
        pairs = _nearest_candidates(feats, tgt, radius, nearest)
    else:
        if great:
            cell, bands, places = _globe_cells(radius)
        else:
            at, bands, places = _flat_cells(radius / CUT, float(radius))
            cell = lambda lat, lon: (at(lat), at(lon))
        t, f = (F.col("t_lat"), F.col("t_lon")), (F.col("f_lat"), F.col("f_lon"))
        most = stations.count() if most is None else most
        tgt = _spread(tgt, most if targets is None else targets.count()).withColumn("band", F.explode(bands(*t)))
        tgt = tgt.withColumn("cell", F.explode(places(*t, F.col("band"))))
        feats = feats.withColumns(dict(zip(("band", "cell"), cell(*f))))
        pairs = tgt.join(F.broadcast(feats) if most <= SENT else feats, ["band", "cell"])
    at = ("t_lat", "t_lon", "f_lat", "f_lon")
    if great:
        distance = haversine(*at, EARTH_KM, cos1="t_cos", cos2="f_cos")
        square, edge = half_chord_square(*at, "t_cos", "f_cos"), math.sin(min(radius / EARTH_KM, math.pi) / 2) ** 2
        sure = lambda slack: square < edge * (1 + slack) + slack * 1e-6  # spares the exact distance away from the border
        near = sure(-1e-9) | (sure(1e-9) & (distance <= radius))
    else:
        distance = degree_distance(*at)
        near = distance < radius
    return pairs.where(near).select("tgt_stid", "feat_stid", distance.alias("distance"), bearing(*at, known).alias("bearing"))


def _nearest_candidates(feats: DataFrame, tgt: DataFrame, radius: float, nearest: int) -> DataFrame:
    """Targets with the stations that may be among their ``nearest`` ones.

    The plane is cut into cells as wide as the radius, halved again and again. In the smallest cell around a target that
    holds ``nearest`` stations, all are within the cell's diagonal, so the target needs no station beyond that. A small
    cell has few such targets, and one at a crowded border looks at the cells next to it only: the work follows stations
    times halvings, however they are spread. Of the stations at one place, the first ``nearest`` by id are enough.
    """
    deepest = max(0, min(HALVINGS, math.floor(math.log2(radius / TIE)))) if radius > 0 else 0
    at, _, _ = _flat_cells(radius, radius, F.col("level"))
    cells = lambda lat, lon: {"band": at(F.col(lat)), "cell": at(F.col(lon))}
    levels = F.explode(F.sequence(F.lit(0), F.lit(deepest)))
    feats = cap_per_target(feats, ["f_lat", "f_lon"], ["feat_stid"], nearest)
    at_levels = feats.withColumn("level", levels).withColumns(cells("f_lat", "f_lon"))
    key = ["level", "band", "cell"]
    full = at_levels.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= nearest).select(key)
    spots = tgt.select("t_lat", "t_lon").distinct().withColumn("level", levels).withColumns(cells("t_lat", "t_lon"))
    found = spots.join(full, key, "left_semi").groupBy("t_lat", "t_lon").agg(F.max("level").alias("level"))
    tgt = tgt.join(found, ["t_lat", "t_lon"], "left")
    diagonal = math.sqrt(2) * radius / F.pow(F.lit(2.0), F.col("level")) + 2 * TIE
    tgt = tgt.withColumn("reach", F.least(F.lit(float(radius)), F.coalesce(diagonal, F.lit(float(radius)))))
    tgt = tgt.withColumn("level", F.coalesce("level", F.lit(0)))
    _, bands, places = _flat_cells(radius, F.col("reach"), F.col("level"))
    t = F.col("t_lat"), F.col("t_lon")
    tgt = tgt.withColumn("band", F.explode(bands(*t)))
    tgt = tgt.withColumn("cell", F.explode(places(*t, F.col("band"))))
    met = tgt.join(at_levels, key)
    return met.where(degree_distance("t_lat", "t_lon", "f_lat", "f_lon") <= F.col("reach") * (1 + 1e-9))


def add_buckets(pairs: DataFrame, distance_width: float = 0.5, bearing_width: float = 30.0) -> DataFrame:
    """Right-closed distance and bearing buckets; the station itself (distance 0) has none."""
    return pairs.withColumns(
        {"vect_close_bkt": width_bin("distance", distance_width), "bearing_bkt": width_bin("bearing", bearing_width)}
    )


def stations_with_all(df: DataFrame, key: str, metric_col: str, required: Sequence[str]) -> DataFrame:
    """Stations that own every required metric: one flag per metric, no distinct."""
    has = df.groupBy(key).agg(*[F.max((F.col(metric_col) == m).cast("int")).alias(f"_has{i}") for i, m in enumerate(required)])
    keep = F.lit(True)
    for i in range(len(required)):
        keep &= F.col(f"_has{i}") == 1
    return has.where(keep).select(key)


def rank_neighbours(df: DataFrame, name_col: str = "feat_stid") -> DataFrame:
    """Rank of each neighbour of a target: bucket first (the target itself is 1), then name."""
    w = Window.partitionBy("tgt_stid").orderBy("bucket_rank", name_col)
    near = df.withColumn("bucket_rank", F.coalesce(F.col("vect_close_bkt") + 1, F.lit(1)))
    return near.withColumn("rank", F.dense_rank().over(w))


def order_neighbours(df: DataFrame, distance_col: str = "distance", ties: Sequence[str] = ()) -> DataFrame:
    """By distance; rows without one (the target) first."""
    return df.orderBy(F.col(distance_col).asc_nulls_first(), *ties)


def cap_per_target(df: DataFrame, key: str | Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` neighbours of each target; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def target_neighbour_list(
    stations: DataFrame, metrics: DataFrame, required: Sequence[str], radius: float, targets: DataFrame | None = None,
    key: str = "stid", metric_col: str = "metric",
) -> DataFrame:
    """Neighbours of every target that own all metrics, with buckets and rank."""
    complete = stations_with_all(metrics, key, metric_col, required).withColumnRenamed(key, "stid")
    known = stations.join(complete, "stid", "left_semi")  # before pairs are made of them
    pairs = station_pairs(known, radius, "degree", stations if targets is None else targets, most=stations.count())
    return rank_neighbours(add_buckets(pairs))

"""Decoding and cleaning of fixed-width measurement fields in long records (STATION, DATE, METRIC, VALUE)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.operators.resample import _explode_span

# fixed values: name, first character, length, kind ("text" or "int") of each field; scale of the measured fields
LAYOUTS = {
    "precip": [("period_hrs", 1, 2, "text"), ("depth_mm", 4, 4, "int"), ("condition_code", 9, 1, "text"), ("quality_code", 11, 1, "text")],
    "humidity": [("period_days", 1, 3, "text"), ("rh_code", 5, 1, "text"), ("rh_pct", 7, 3, "int"), ("derived_code", 11, 1, "text"), ("quality_code", 13, 1, "text")],
    "temperature": [("degrees_cels", 1, 5, "int"), ("quality_code", 7, 1, "text")],
    "pressure": [("hectopascals", 1, 5, "int"), ("quality_code", 7, 1, "text")],
    "wind": [("angle", 1, 3, "int"), ("angle_quality", 5, 1, "text"), ("type_code", 7, 1, "text"), ("speed", 9, 4, "int"), ("quality_code", 14, 1, "text")],
    "ceiling": [("height_m", 1, 5, "int"), ("quality_code", 7, 1, "text"), ("determination_code", 9, 1, "text"), ("cavok_code", 11, 1, "text")],
}
SCALES = {"depth_mm": 10, "rh_pct": 1, "degrees_cels": 10, "hectopascals": 10, "angle": 1, "speed": 10, "height_m": 1}

# fixed values: metadata repeated on every raw record; quality codes that are kept
METADATA = ("SOURCE", "LATITUDE", "LONGITUDE", "ELEVATION", "NAME", "REPORT_TYPE", "CALL_SIGN", "QUALITY_CONTROL")
GOOD_DEPTH_OR_TEMP = ("0", "1", "4", "5", "9")
GOOD_HUMIDITY = ("0", "1", "4", "5")


def _decode(df: DataFrame, layout: str, col: str) -> DataFrame:
    made = {}
    for name, start, length, kind in LAYOUTS[layout]:
        text = F.when(F.length(col) > 0, F.substring(col, start, length))
        made[name] = text.try_cast("int") if kind == "int" else text
        if name in SCALES:
            made[f"{name}_scale"] = F.lit(SCALES[name])
    return df.withColumns(made)


def decode_precip(df: DataFrame, col: str = "VALUE") -> DataFrame:
    return _decode(df, "precip", col)


def decode_humidity(df: DataFrame, col: str = "VALUE") -> DataFrame:
    return _decode(df, "humidity", col)


def decode_temperature(df: DataFrame, col: str = "VALUE") -> DataFrame:
    return _decode(df, "temperature", col)


def decode_pressure(df: DataFrame, col: str = "VALUE") -> DataFrame:
    return _decode(df, "pressure", col)


def decode_wind(df: DataFrame, col: str = "VALUE") -> DataFrame:
    return _decode(df, "wind", col)


def decode_ceiling(df: DataFrame, col: str = "VALUE") -> DataFrame:
    return _decode(df, "ceiling", col)


def flag_empty_value(df: DataFrame, col: str = "VALUE") -> DataFrame:
    return df.withColumn("is_empty", F.coalesce(F.length(col) == 0, F.lit(True)))


def drop_metadata(df: DataFrame, cols: Sequence[str] = METADATA) -> DataFrame:
    return df.drop(*cols)


def keep_quality(df: DataFrame, col: str, codes: Sequence[str], mode: str = "drop", value: str | None = None) -> DataFrame:
    """Keep rows with a good code, or (``mode="null"``) blank ``value`` where the code is bad."""
    good = F.col(col).isin(*codes)
    if mode == "drop":
        return df.where(good)
    if mode != "null" or value is None:
        raise ValueError("mode is 'drop', or 'null' with a value column")
    return df.withColumn(value, F.when(good, F.col(value)))


def drop_sentinels(df: DataFrame, col: str, lo=None, hi=None, sentinels: Sequence = ()) -> DataFrame:
    """Keep lo <= value < hi and values that are no sentinel."""
    x, keep = F.col(col), F.col(col).isNotNull()
    if lo is not None:
        keep &= x >= lo
    if hi is not None:
        keep &= x < hi
    if sentinels:
        keep &= ~x.isin(*sentinels)
    return df.where(keep)


def apply_scale(df: DataFrame, col: str, scale, name: str | None = None) -> DataFrame:
    return df.withColumn(name or col, F.col(col) / (F.col(scale) if isinstance(scale, str) else F.lit(scale)))


def keep_period(df: DataFrame, hours: str = "01") -> DataFrame:
    return df.where(F.col("period_hrs") == hours)


def add_day_hour(df: DataFrame, ts_col: str = "DATE") -> DataFrame:
    return df.withColumns(
        {"Date_YYYYMMDD": F.to_date(ts_col), "HOUR": F.lpad(F.hour(ts_col).cast("string"), 2, "0")}
    )


def melt_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide measures to (ids, METRIC, VALUE); cells that were never reported are left out."""
    return df.select(*ids, *metrics).unpivot(list(ids), list(metrics), "METRIC", "VALUE").where("VALUE IS NOT NULL")


def first_of_duplicates(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Repeats of the same value in a key keep only the earliest time (an aggregate, so repeats meet map-side)."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def decode_lookup(dates: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a table of decoded values, for records that arrive dictionary-coded."""
    return dates.join(values, list(keys), "left")


def _day_hour_grid(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    span = df.groupBy(*keys).agg(
        F.min(day).cast("timestamp").alias("_lo"), (F.max(day).cast("timestamp") + F.make_dt_interval(hours=F.lit(23))).alias("_hi")
    )
    grid = _explode_span(span, keys, "_at", 3600)
    return grid.select(*keys, F.to_date("_at").alias(day), F.lpad(F.hour("_at").cast("string"), 2, "0").alias("HOUR"))


def hourly_precip(df: DataFrame, key: str = "STATION") -> DataFrame:
    """Sum of good one-hour depths per day and hour, on the full calendar between first and last day."""
    days = [key, "Date_YYYYMMDD", "HOUR"]
    one_hour = add_day_hour(keep_period(decode_precip(df.where("METRIC IN ('AA1', 'AA2', 'AA3')"))))
    single = decode_precip(first_of_duplicates(one_hour, [*days, "METRIC", "VALUE"], "DATE"))
    good = drop_sentinels(keep_quality(single, "quality_code", GOOD_DEPTH_OR_TEMP), "depth_mm", 0, 9999)
    scaled = apply_scale(good, "depth_mm", "depth_mm_scale", "precip_depth_mm")
    summed = scaled.groupBy(*days).agg(F.max("period_hrs").alias("period_hrs"), F.sum("precip_depth_mm").alias("precip_depth_sum_mm"))
    return _day_hour_grid(one_hour, [key], "Date_YYYYMMDD").join(summed, days, "left")


def hourly_temperature(df: DataFrame, key: str = "STATION") -> DataFrame:
    """Mean of the distinct good readings per day and hour; hours with only bad readings stay, as null."""
    days = [key, "Date_YYYYMMDD", "HOUR"]
    decoded = add_day_hour(decode_temperature(df.where("METRIC = 'TMP'")))
    good = F.col("quality_code").isin(*GOOD_DEPTH_OR_TEMP) & (F.col("degrees_cels") != 9999)
    value = F.when(good, F.col("degrees_cels") / F.col("degrees_cels_scale"))
    distinct = decoded.select(*days, value.alias("air_temp_degrees_cels")).distinct()
    return distinct.groupBy(*days).agg(F.avg("air_temp_degrees_cels").alias("air_temp_degrees_cels")).withColumn("period_hrs", F.lit("01"))


HUMIDITY_SLOTS = {"RH1": "Max_RH_pct", "RH2": "Rel_Hum_pct", "RH3": "Mean_RH_pct"}


def daily_humidity(df: DataFrame, key: str = "STATION") -> DataFrame:
    """One row per report time with the three humidity measures; values with a bad code are null."""
    decoded = decode_humidity(df.where(F.col("METRIC").isin(*HUMIDITY_SLOTS)))
    scaled = keep_quality(apply_scale(decoded, "rh_pct", "rh_pct_scale"), "quality_code", GOOD_HUMIDITY, "null", "rh_pct")
    wide = scaled.groupBy(key, "DATE").agg(
        *[F.min(F.when(F.col("METRIC") == m, F.col("rh_pct"))).alias(n) for m, n in HUMIDITY_SLOTS.items()]
    )
    return add_day_hour(wide).withColumn("period_hrs", F.lit("24")).drop("DATE")


CLEANERS = {"precip": hourly_precip, "humidity": daily_humidity, "temperature": hourly_temperature}


def clean_station(df: DataFrame, metric: str) -> DataFrame:
    """Decode, filter, grid and aggregate all stations of the frame for one metric."""
    return CLEANERS[metric](df)


def pivot_metrics(df: DataFrame, keys: Sequence[str], names: Sequence[str], metric: str = "METRIC", value: str = "VALUE") -> DataFrame:
    """Long to wide with a given name list: no job to look for the names, one pass of partial aggregates."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(metric) == n, F.col(value))).alias(n) for n in names])


def add_country_state(df: DataFrame, name_col: str = "NAME") -> DataFrame:
    """Country: last two characters of the name; state: the two before ``' US'``, else ``-``."""
    name = F.col(name_col)
    country = F.right(name, F.lit(2))
    state: Column = F.when(country == "US", F.left(F.right(name, F.lit(5)), F.lit(2))).otherwise("-")
    return df.withColumns({"COUNTRY": country, "US_State": state})

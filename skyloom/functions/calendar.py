"""Calendar features, relative-time names and period arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

_UNIT_SECONDS = {"s": 1, "sec": 1, "t": 60, "min": 60, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_TRUNC = {"mo": "month", "me": "month", "ms": "month", "q": "quarter", "y": "year", "w": "week"}


def parse_period(period: str) -> tuple[int, str]:
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", period)
    if not match:
        raise ValueError(f"not a period: {period!r}")
    unit = match.group(2).lower()
    if unit not in _UNIT_SECONDS and unit not in _TRUNC:
        raise ValueError(f"unknown period unit in {period!r}")
    return int(match.group(1) or 1), unit


def period_seconds(period: str) -> int:
    """Length of a fixed period; months, quarters and years have none."""
    n, unit = parse_period(period)
    if unit not in _UNIT_SECONDS:
        raise ValueError(f"period {period!r} has no fixed length")
    return n * _UNIT_SECONDS[unit]


def period_start(col, period: str) -> Column:
    """Start of the period that holds the time: weeks from Monday, calendar months, else steps counted from the epoch."""
    x = F.col(col) if isinstance(col, str) else col
    n, unit = parse_period(period)
    if unit in _TRUNC:
        if n != 1:
            raise ValueError(f"only single {_TRUNC[unit]} periods are supported: {period!r}")
        return F.date_trunc(_TRUNC[unit], x)
    width = n * _UNIT_SECONDS[unit]
    if width in (3600, 86400):
        return F.date_trunc("hour" if width == 3600 else "day", x)
    return F.timestamp_seconds(F.floor(F.unix_seconds(x) / width) * width)


def _scaled(part: Column, offset: int, top: float) -> Column:
    return (part - offset) / F.lit(top) - 0.5


# fixed values: which parts a sampling frequency carries
RAW_PARTS = {
    "y": [], "m": ["month"], "w": ["month"], "d": ["month", "day", "weekday"], "b": ["month", "day", "weekday"],
    "h": ["month", "day", "weekday", "hour"], "t": ["month", "day", "weekday", "hour", "minute"],
}
SCALED_PARTS = {
    "y": [], "q": ["month"], "m": ["month"], "w": ["day", "week"], "d": ["weekday", "day", "dayofyear"],
    "b": ["weekday", "day", "dayofyear"], "h": ["hour", "weekday", "day", "dayofyear"],
    "t": ["minute", "hour", "weekday", "day", "dayofyear"], "s": ["second", "minute", "hour", "weekday", "day", "dayofyear"],
}


def time_features(ts, freq: str = "h", scaled: bool = False) -> dict[str, Column]:
    """Calendar parts by name: whole numbers, or each scaled to [-0.5, 0.5]."""
    x = F.col(ts) if isinstance(ts, str) else ts
    table = SCALED_PARTS if scaled else RAW_PARTS
    if freq.lower() not in table:
        raise ValueError(f"unsupported frequency {freq!r}")
    if scaled:
        parts = {
            "second": _scaled(F.second(x), 0, 59.0), "minute": _scaled(F.minute(x), 0, 59.0),
            "hour": _scaled(F.hour(x), 0, 23.0), "weekday": _scaled(F.weekday(x), 0, 6.0),
            "day": _scaled(F.dayofmonth(x), 1, 30.0), "dayofyear": _scaled(F.dayofyear(x), 1, 365.0),
            "month": _scaled(F.month(x), 1, 11.0), "week": _scaled(F.weekofyear(x), 1, 52.0),
        }
    else:
        parts = {
            "month": F.month(x), "day": F.dayofmonth(x), "weekday": F.weekday(x), "hour": F.hour(x),
            "minute": F.floor(F.minute(x) / 15).cast("int"),
        }
    return {name: parts[name] for name in table[freq.lower()]}


# fixed values: smallest and largest code of each attribute
ATTRIBUTE_RANGES = {
    "day": (1, 31), "hour": (0, 23), "minute": (0, 59), "second": (0, 59), "month": (1, 12), "year": (1950, 2010),
    "dayofweek": (0, 6), "dayofyear": (1, 366), "quarter": (1, 4), "week": (1, 53), "is_month_start": (0, 1),
    "is_month_end": (0, 1), "is_quarter_start": (0, 1), "is_quarter_end": (0, 1), "is_year_start": (0, 1),
    "is_year_end": (0, 1), "is_leap_year": (0, 1),
}


def timestamp_attributes(ts, features=None, scaled: bool = False) -> dict[str, Column]:
    """Attribute codes counted from the smallest value (0 for a missing time), or scaled by ``2x / range - 1``."""
    x = F.col(ts) if isinstance(ts, str) else ts
    d = F.to_date(x)
    month, day = F.month(x), F.dayofmonth(x)
    last = F.last_day(d) == d
    flag = lambda c: c.cast("int")
    year = F.year(x)
    parts = {
        "day": day, "hour": F.hour(x), "minute": F.minute(x), "second": F.second(x), "month": month, "year": year,
        "dayofweek": F.weekday(x), "dayofyear": F.dayofyear(x), "quarter": F.quarter(x), "week": F.weekofyear(x),
        "is_month_start": flag(day == 1), "is_month_end": flag(last),
        "is_quarter_start": flag((day == 1) & (month % 3 == 1)), "is_quarter_end": flag(last & (month % 3 == 0)),
        "is_year_start": flag((day == 1) & (month == 1)), "is_year_end": flag((month == 12) & (day == 31)),
        "is_leap_year": flag(((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)),
    }
    out = {}
    for name in features or ATTRIBUTE_RANGES:
        low, high = ATTRIBUTE_RANGES[name]
        code = F.coalesce(parts[name] - low, F.lit(0))
        out[name] = (2 * code / F.lit(float(high - low + 2)) - 1) if scaled else code
    return out


def calendar_keys(df: DataFrame, date_col: str, hour_col: str) -> DataFrame:
    """Month, ISO week, day of year and a two-digit hour; an unreadable hour counts as 0."""
    hour = F.coalesce(F.expr(f"try_cast(`{hour_col}` AS INT)"), F.lit(0))
    return df.withColumns(
        {
            "month": F.month(date_col), "week": F.weekofyear(date_col), "dayofyear": F.dayofyear(date_col),
            "nhour": hour, "hour_text": F.lpad(hour.cast("string"), 2, "0"),
        }
    )


RELATIVE_NAME = "D([0-9]+)H([0-9]+)"


def decode_relative(df: DataFrame, name_col: str, ref, out: str = "datetime", legacy: bool = False) -> DataFrame:
    """Time of a name like ``PRD000044H23``: reference day minus 44 days plus 23 hours.

    ``legacy`` uses the older rule, ``ref - (days - 1) - (24 - hours)``; both give the same instant.
    """
    ref = F.col(ref) if isinstance(ref, str) else ref
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract(`{name_col}`, '{RELATIVE_NAME}', {i}), '') AS INT)")
    days, hours = part(1), part(2)
    if legacy:
        days, hours = days - 1, hours - 24
    return df.withColumn(out, ref.cast("timestamp") + F.make_dt_interval(-days, hours))


def encode_relative(df: DataFrame, prefix: str, as_of, date_col: str, hour_col: str, out: str = "var_name") -> DataFrame:
    """Name of an observation counted back from ``as_of``: prefix, six-digit days ago, two-digit hour."""
    as_of = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    ago = F.lpad(F.datediff(as_of, F.col(date_col)).cast("string"), 6, "0")
    return df.withColumn(out, F.concat(F.lit(prefix + "D"), ago, F.lit("H"), F.lpad(F.col(hour_col).cast("string"), 2, "0")))

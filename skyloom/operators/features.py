"""Lag, rolling and gap features that never see the current or later values."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skyloom.functions.binning import bin_col
from skyloom.functions.calendar import parse_period, period_seconds
from skyloom.operators.resample import _calendar_steps, calendar_grid, summarise
from skyloom.slicing import carry, micros, own_rows, row_frames, sliced, time_slices

logger = logging.getLogger(__name__)

SLICE_ROWS = 20_000
SLICE_DAYS = 32


# --- row filters on series -----------------------------------------------------------------------------------------
def last_years(df: DataFrame, ts_col: str, years: float) -> DataFrame:
    """Rows from ``int(years * 12)`` months before the newest time of all stations on."""
    if years <= 0:
        raise ValueError("years must be positive")
    return _since(df, ts_col, lambda top: top - F.make_ym_interval(F.lit(0), F.lit(int(years * 12))))


def last_months_30d(df: DataFrame, ts_col: str, months: int) -> DataFrame:
    """Rows of the last ``months`` months of 30 days."""
    return _since(df, ts_col, lambda top: top - F.make_dt_interval(F.lit(int(months) * 30)))


def _since(df: DataFrame, ts_col: str, rule) -> DataFrame:
    cutoff = df.agg(F.max(ts_col).alias("top")).select(rule(F.col("top")))
    return df.where(F.col(ts_col) >= cutoff.scalar())


def align_tail(df: DataFrame, key: str, ts_col: str, n_rows: int, slices=None) -> DataFrame:
    """Rows strictly before the earliest of the stations' last times, then the last ``n_rows`` of each station."""
    from skyloom.slicing import with_ordinal

    end = df.groupBy(key).agg(F.max(ts_col).alias("last")).agg(F.min("last"))
    cut = df.where(F.col(ts_col) < end.scalar())
    numbered = with_ordinal(cut, [key], [ts_col], slices or time_slices(ts_col, "month"))
    sizes = cut.groupBy(key).agg(F.count("*").alias("_n"))
    return numbered.join(sizes, key).where(F.col("pos") > F.col("_n") - n_rows).drop("_n", "pos")


def keep_finite(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def keep_wet_windows(df: DataFrame, amount) -> DataFrame:
    """Rows whose preceding window (a number, or an array of amounts) holds any rain."""
    if isinstance(df.schema[amount].dataType, T.ArrayType):
        return df.where(F.exists(amount, lambda x: x > 0))
    return df.where(F.col(amount) > 0)


# --- regular grids and gap filling ---------------------------------------------------------------------------------
def densify(df: DataFrame, key: str, ts_col: str, freq: str) -> DataFrame:
    """Regular grid from each station's first to last time; rows off the grid are left out, missing steps are null."""
    _, unit = parse_period(freq)
    if unit in ("mo", "me", "ms", "q", "y"):
        grid = _calendar_steps(df, [key], ts_col, unit)
    else:
        grid = calendar_grid(df, [key], ts_col, freq)
    return grid.join(df, [key, ts_col], "left").select(df.columns)


def _span_slice(ts_col: str, days: int = SLICE_DAYS) -> Column:
    return F.floor(F.unix_seconds(ts_col) / (days * 86400)).cast("long")


def interpolate_time(df: DataFrame, key: str, ts_col: str, cols: Sequence[str]) -> DataFrame:
    """Fill gaps: numbers linearly in time, texts with the last known value; ends are held flat."""
    if not cols:
        return df
    filled = carry(df, [key], ts_col, _span_slice(ts_col), cols, ahead=True)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    out = {}
    for c in cols:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        hold = F.coalesce(prev["value"], nxt["value"])
        if c in numeric:
            gap = (micros(nxt["at"]) - micros(prev["at"])).cast("double")
            share = (micros(ts_col) - micros(prev["at"])) / gap
            line = prev["value"] + (nxt["value"] - prev["value"]) * share
            out[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(gap > 0, line).otherwise(hold)
        else:
            out[c] = hold
    return filled.withColumns(out).select(df.columns)


def forward_fill(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    filled = carry(df, [key], order, _span_slice(order), cols)
    return filled.withColumns({c: F.col(f"_prev_{c}")["value"] for c in cols}).select(df.columns)


# --- lags ----------------------------------------------------------------------------------------------------------
def lag_count(lookback_days: float, freq: str) -> int:
    return max(1, int(lookback_days * 86400 / period_seconds(freq)))


def _step_frame(df: DataFrame, key: str, ts_col: str, step_us: int, n: int):
    """Copies and window for a frame of ``n`` earlier steps on a regular grid."""
    cut = sliced(df, micros(ts_col), SLICE_DAYS * 86_400_000_000, before=n * step_us)
    return cut, Window.partitionBy(key, "_slice").orderBy(ts_col)


def _lags(col: str, window, n: int, gap: int = 0) -> Column:
    """The ``n`` values before the row, newest first; nulls keep their place."""
    boxed = F.collect_list(F.struct(F.col(col).alias("v"))).over(window.rowsBetween(-n - gap, -1 - gap))
    return F.transform(F.reverse(boxed), lambda s: s["v"])


def lag_arrays(df: DataFrame, cols: Sequence[str], n: int, freq: str, key: str = "stationid", ts_col: str = "datetime") -> DataFrame:
    """Add ``{col}_lags``: arrays of the ``n`` earlier grid values, lag 1 first. Rows without all lags are dropped."""
    cut, w = _step_frame(df, key, ts_col, period_seconds(freq) * 1_000_000, n)
    out = own_rows(cut.withColumns({f"{c}_lags": _lags(c, w, n) for c in cols}))
    return out.where(F.size(f"{cols[0]}_lags") == n)


def lag_features(
    df: DataFrame,
    target: str,
    indep_vars: Sequence[str] = (),
    lookback_days: float = 7,
    freq: str = "1h",
    layout: str = "array",
    stations: Sequence[str] | None = None,
    key: str = "stationid",
    ts_col: str = "datetime",
) -> DataFrame:
    """Grid, fill and lag every station: ``y`` is the current target, lags are strictly older.

    ``layout="array"`` gives one array column per variable; ``"wide"`` gives ``{station}_{var}_lag_{k}`` columns for
    the listed stations (a bounded list).
    """
    cols = list(dict.fromkeys([target, *indep_vars]))
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"variable {c!r} missing")
    n = lag_count(lookback_days, freq)
    grid = interpolate_time(densify(df.select(key, ts_col, *cols), key, ts_col, freq), key, ts_col, cols)
    lagged = lag_arrays(grid, cols, n, freq, key, ts_col).select(
        key, ts_col, F.col(target).alias("y"), *[f"{c}_lags" for c in cols]
    )
    if layout == "array":
        return lagged
    if not stations:
        raise ValueError("the wide layout needs the station list")
    return widen(lagged, cols, stations, n, key, ts_col)


def widen(lagged: DataFrame, cols: Sequence[str], stations: Sequence[str], n: int, key: str, ts_col: str) -> DataFrame:
    mine = [
        F.when(F.col(key) == s, F.col(f"{c}_lags")[k - 1]).alias(f"{s}_{c}_lag_{k}")
        for s in map(str, stations) for c in cols for k in range(1, n + 1)
    ]
    return lagged.select(key, ts_col, "y", *mine)


def attach_aux_lags(
    lagged: DataFrame, cols: Sequence[str], stations: Sequence[str], aux: Sequence[str], n: int,
    key: str = "stationid", ts_col: str = "datetime",
) -> DataFrame:
    """Wide frame of the primary stations with every auxiliary station's lags of the same time beside them.

    Stations in ``aux`` give columns, not rows; if no primary station is left, all stations are primary.
    """
    stations, aux = [str(s) for s in stations], [str(s) for s in aux]
    primary = [s for s in stations if s not in aux]
    if not primary:
        logger.warning("no primary station left after taking out %s; using all stations", aux)
        primary = stations
    known = [a for a in aux if a in stations]
    for a in set(aux) - set(known):
        logger.warning("auxiliary station %s has no data", a)
    rows = widen(lagged.where(F.col(key).isin(primary)), cols, primary, n, key, ts_col)
    if not known:
        return rows
    # one row per time: a bounded number of arrays, picked with conditional aggregates
    picked = lagged.where(F.col(key).isin(known)).groupBy(ts_col).agg(
        *[F.first(F.when(F.col(key) == s, F.col(f"{c}_lags")), ignorenulls=True).alias(f"_{i}_{c}")
          for i, s in enumerate(known) for c in cols]
    )
    side = picked.select(
        ts_col,
        *[F.col(f"_{i}_{c}")[k - 1].alias(f"{s}_{c}_lag_{k}")
          for i, s in enumerate(known) for c in cols for k in range(1, n + 1)
          if f"{s}_{c}_lag_{k}" not in rows.columns],
    )
    return rows.join(side, ts_col, "left").select(*rows.columns, *[c for c in side.columns if c != ts_col])


def add_lags(df: DataFrame, order: str, col: str, n: int, slices=None) -> DataFrame:
    """``{col}_lag_1..n`` of a single series by row; incomplete rows stay, with nulls."""
    frame, w = row_frames(df, [], [order], slices or time_slices(order, "month"), before=n)
    lags = {f"{col}_lag_{k}": F.lag(col, k).over(w) for k in range(1, n + 1)}
    return own_rows(frame.withColumns(lags)).drop("pos")


def gap_features(df: DataFrame, keys: Sequence[str], ts_col: str, target: str, gap_rows: int, n_rows: int, slices=None) -> DataFrame:
    """Target at a row, features from the ``n_rows`` rows that end ``gap_rows`` rows earlier; month and hour kept."""
    frame, w = row_frames(df, keys, [ts_col], slices or time_slices(ts_col, "month"), before=gap_rows + n_rows)
    out = frame.withColumns(
        {"features": _lags(target, w, n_rows, gap_rows), "month": F.month(ts_col), "hour": F.hour(ts_col)}
    )
    return own_rows(out).where(F.size("features") == n_rows).drop("pos")


def lag_matrix(df: DataFrame, keys: Sequence[str], ts_col: str, metrics: Sequence[str], n_rows: int, slices=None) -> DataFrame:
    """``history``: the row's and the ``n_rows - 1`` older rows' full metric structs, newest first; full windows only."""
    frame, w = row_frames(df, keys, [ts_col], slices or time_slices(ts_col, "month"), before=n_rows)
    rows = F.reverse(F.collect_list(F.struct(*metrics)).over(w.rowsBetween(-(n_rows - 1), 0)))
    return own_rows(frame.withColumn("history", rows)).where(F.size("history") == n_rows).drop("pos")


def align_to_target(df: DataFrame, target: str, neighbours: Sequence[str], cols: Sequence[str], key: str, ts_col: str) -> DataFrame:
    """Target station's rows with each neighbour's columns of the same time (``{col}_{rank}``), null where missing."""
    mine = df.where(F.col(key) == target).select(ts_col, *cols)
    near = df.where(F.col(key).isin([str(s) for s in neighbours])).groupBy(ts_col).agg(
        *[F.first(F.when(F.col(key) == str(s), F.col(c)), ignorenulls=True).alias(f"{c}_{i}")
          for i, s in enumerate(neighbours, 1) for c in cols]
    )
    return mine.join(near, ts_col, "left")


# --- rolling -------------------------------------------------------------------------------------------------------
def _middle(values: Column) -> Column:
    low, high = F.floor((F.size(values) - 1) / 2).cast("int"), F.floor(F.size(values) / 2).cast("int")
    return (F.get(values, low) + F.get(values, high)) / 2


ROLLING = {
    "sum": lambda c, rows: F.sum(c).over(rows), "min": lambda c, rows: F.min(c).over(rows), "max": lambda c, rows: F.max(c).over(rows),
    "mean": lambda c, rows: F.avg(c).over(rows), "std": lambda c, rows: F.stddev_samp(c).over(rows),
    "var": lambda c, rows: F.var_samp(c).over(rows), "count": lambda c, rows: F.count(c).over(rows),
    "first": lambda c, rows: F.first(c).over(rows), "last": lambda c, rows: F.last(c).over(rows),
    "n_unique": lambda c, rows: F.size(F.array_distinct(F.collect_list(c).over(rows))),
    "median": lambda c, rows: _middle(F.sort_array(F.collect_list(c).over(rows))),
}


def rolling_history(
    df: DataFrame,
    agg_map: Mapping[str, Sequence[str]],
    windows: Sequence[int],
    stations: Sequence[str],
    key: str = "stationid",
    ts_col: str = "datetime",
    legacy_double_shift: bool = False,
    slices=None,
) -> DataFrame:
    """Rolling summaries of the rows before each row, then one value per time over the stations.

    Columns ``{prefix}_{var}_{method}_{w}d``: null until ``w`` earlier values exist. ``legacy_double_shift`` delays
    methods other than mean, min, max and sum by one more row.
    """
    prefix = "multistations" if len(stations) > 1 else (str(stations[0]) if stations else "aux")
    plan = []
    for var, methods in agg_map.items():
        if var not in df.columns:
            logger.warning("variable %s not found, skipped", var)
            continue
        plan += [(var, m, w) for m in methods for w in windows or []]
    for _, m, _ in plan:
        if m not in ROLLING:
            raise ValueError(f"unknown aggregation {m!r}")
    if stations:
        df = df.where(F.col(key).cast("string").isin([str(s) for s in stations]))
    if not plan:
        return df.select(ts_col).limit(0)
    used = list(dict.fromkeys(v for v, _, _ in plan))
    reach = max(w for _, _, w in plan) + 1
    frame, order = row_frames(df.select(key, ts_col, *used), [key], [ts_col], slices or time_slices(ts_col, "month"), before=reach)
    made = {}
    for var, m, w in plan:
        late = 1 if legacy_double_shift and m not in ("mean", "min", "max", "sum") else 0
        rows = order.rowsBetween(-w - late, -1 - late)
        made[f"{prefix}_{var}_{m}_{w}d"] = F.when(F.count(var).over(rows) == w, ROLLING[m](var, rows))
    rolled = own_rows(frame.withColumns(made)).select(key, ts_col, *made)
    by_method: dict[str, list[str]] = {}
    for var, m, w in plan:
        by_method.setdefault(m, []).append(f"{prefix}_{var}_{m}_{w}d")
    plain = {c: [m] for m, cs in by_method.items() for c in cs}
    out = summarise(rolled, [ts_col], plain, ts_col, name=lambda c, op: c)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in by_method.get("sum", [])})


def rolling_time(
    df: DataFrame, keys: Sequence[str], ts_col: str, aggs: Mapping[str, tuple[str, str]], hours: int = 24,
    min_count: int = 6, direction: str = "backward", slice_days: int = 8,
) -> DataFrame:
    """Time-range frames ``(t - hours, t]`` (``forward``: ``[t, t + hours)``).

    ``aggs`` maps a new name to (column, "sum" or "mean"); sums take nulls as 0, means need ``min_count`` values.
    A task holds ``slice_days`` of a key and the rows its first frames reach back to: fewer days for denser series.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is 'backward' or 'forward'")
    width = hours * 3_600_000_000 - 1
    before, after = (width, 0) if direction == "backward" else (0, width)
    cut = sliced(df.withColumn("_us", micros(ts_col)), F.col("_us"), slice_days * 86_400_000_000, before, after)
    w = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-before, after)
    made = {}
    for name, (c, how) in aggs.items():
        if how == "sum":
            made[name] = F.sum(F.coalesce(F.col(c), F.lit(0))).over(w)
        elif how == "mean":
            made[name] = F.when(F.count(c).over(w) >= min_count, F.avg(c).over(w))
        else:
            raise ValueError(f"unknown rolling function {how!r}")
    return own_rows(cut.withColumns(made)).drop("_us")


def wet_flag(df: DataFrame, ts_col: str, avg_col: str, n: int = 8, slices=None) -> DataFrame:
    """Sum of the preceding ``n`` regional means and whether it is above 0."""
    frame, w = row_frames(df, [], [ts_col], slices or time_slices(ts_col, "month"), before=n)
    total = F.sum(avg_col).over(w.rowsBetween(-n, -1))
    return own_rows(frame.withColumn("rain_sum", total)).withColumn("is_wet", (F.col("rain_sum") > 0).cast("int")).drop("pos")


def pct_wet(df: DataFrame, ts_col: str, n: int = 8, slices=None) -> DataFrame:
    """Share of reporting stations with rain, for ``n`` earlier periods: an array, null where none reported."""
    share = F.when(F.col("cnt_ge0") > 0, F.col("cnt_gt0") / F.col("cnt_ge0"))
    frame, w = row_frames(df.withColumn("_share", share), [], [ts_col], slices or time_slices(ts_col, "month"), before=n)
    return own_rows(frame.withColumn("pct_wet", _lags("_share", w, n))).drop("pos", "_share")


def lag_differences(df: DataFrame, array_col: str, name: str = "diffs") -> DataFrame:
    """Differences of neighbouring array entries: a[k] - a[k + 1]."""
    a = F.col(array_col)
    n = F.size(a)
    pairs = F.zip_with(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: x - y)
    return df.withColumn(name, pairs)


# --- outputs -------------------------------------------------------------------------------------------------------
def select_output(df: DataFrame, mode: str, roles: Mapping[str, Sequence[str]]) -> DataFrame:
    """``primary``, ``both`` or ``aux`` columns by recorded role; an unknown mode means ``primary``."""
    base, own, aux = (list(roles.get(k, ())) for k in ("base", "primary", "aux"))
    if mode not in ("primary", "both", "aux"):
        logger.warning("unknown output mode %r; using 'primary'", mode)
        mode = "primary"
    return df.select(*base, *(own if mode != "aux" else []), *(aux if mode != "primary" else []))


def drop_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def unique_columns(names: Sequence[str]) -> list[str]:
    """Names without repeats, first place kept."""
    return list(dict.fromkeys(names))


def target_first(df: DataFrame, target: str) -> DataFrame:
    return df.select(target, *[c for c in df.columns if c != target])


def rename_positional(df: DataFrame, mapping: Mapping[int, str]) -> DataFrame:
    """Rename columns by position (from 0)."""
    return df.toDF(*[mapping.get(i, c) for i, c in enumerate(df.columns)])


def newest_first(df: DataFrame, ts_col: str, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(ts_col).desc(), *ties)


def order_series(df: DataFrame, key: str = "stationid", ts_col: str = "datetime") -> DataFrame:
    return df.orderBy(key, ts_col)


def merge_target_neighbour(target: DataFrame, neighbour: DataFrame, key: str, suffix: str = "_target") -> DataFrame:
    """Left join on time; clashing neighbour names get the suffix."""
    clash = {c: f"{c}{suffix}" for c in neighbour.columns if c in target.columns and c != key}
    return target.join(neighbour.withColumnsRenamed(clash), key, "left")


def lag_aux(aux: DataFrame, ts_col: str, cols: Sequence[str], n: int, slices=None) -> DataFrame:
    """``{col}_lag_k`` over the rows of the auxiliary frame (by row, not by time)."""
    frame, w = row_frames(aux.select(ts_col, *cols), [], [ts_col], slices or time_slices(ts_col, "month"), before=n)
    lags = [F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in cols for k in range(1, n + 1)]
    return own_rows(frame.select(ts_col, "_own", "_slice", *lags))


def dependent_frame(
    df: DataFrame, target_var: str, lookback_days: float = 7, freq: str = "1h", *, stations: Sequence[str],
    indep_vars: Sequence[str] = (), aux_stations: Sequence[str] = (), aux_dfs: Sequence[DataFrame] = (),
    aux_output_mode: str = "primary", years_back: float | None = None, drop_date_stationid: bool = True,
    bins: Sequence[float] | None = None, labels: Sequence | None = None, key: str = "stationid", ts_col: str = "datetime",
    sort: bool = True,
) -> DataFrame:
    """Model frame: ``y`` and wide lags of the primary stations, auxiliary lags beside them, newest row first."""
    from skyloom.operators.resample import merge_aux

    indep_vars = list(indep_vars or [])
    cols = list(dict.fromkeys([target_var, *indep_vars]))
    aux_frame = merge_aux(aux_dfs, ts_col, key) if aux_dfs else None
    if years_back is not None:
        cut = last_years(df, ts_col, years_back)
        if aux_frame is not None:
            low = df.agg(F.max(ts_col) - F.make_ym_interval(F.lit(0), F.lit(int(years_back * 12))))
            aux_frame = aux_frame.where(F.col(ts_col) >= low.scalar())
        df = cut
    n = lag_count(lookback_days, freq)
    stations = [str(s) for s in stations]
    df = df.where(F.col(key).isin(stations))
    lagged = lag_features(df, target_var, indep_vars, lookback_days, freq, "array", None, key, ts_col)
    wide = attach_aux_lags(lagged, cols, stations, list(aux_stations), n, key, ts_col)
    base = [ts_col, key, "y"]
    primary = [c for c in wide.columns if c not in base]
    if aux_frame is not None:
        names = [c for c in aux_frame.columns if c not in (ts_col, key)]
        aux_lags = lag_aux(aux_frame, ts_col, names, n)
        wide = wide.join(aux_lags, ts_col, "left")
        roles = {"base": base, "primary": primary, "aux": [c for c in aux_lags.columns if c != ts_col]}
        wide = select_output(wide, aux_output_mode, roles)
    else:
        wide = wide.select(*base, *primary)
    if sort:
        wide = newest_first(wide, ts_col, [key])
    if bins is not None and labels is not None:
        wide = wide.withColumn("y", bin_col("y", bins, labels, closed="left", outside="null"))
    return drop_keys(wide, [ts_col, key]) if drop_date_stationid else wide

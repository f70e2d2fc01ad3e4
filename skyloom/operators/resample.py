"""Periodic summaries of observation series."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.functions.calendar import parse_period, period_seconds, period_start
from skyloom.operators.quantiles import exact_quantiles
from skyloom.slicing import ranged, running_total, with_ordinal

logger = logging.getLogger(__name__)

DEFAULT_OPS = ("sum", "min", "max", "median", "mean", "std")
COPIES = 8192  # equal rows numbered in one array


def _first(c: str, at: str) -> Column:
    return F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(at), F.col(c))))[c]


def _last(c: str, at: str) -> Column:
    return F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(at), F.col(c))))[c]


OPS = {
    "sum": lambda c, at: F.sum(c), "min": lambda c, at: F.min(c), "max": lambda c, at: F.max(c),
    "mean": lambda c, at: F.avg(c), "std": lambda c, at: F.stddev_samp(c), "var": lambda c, at: F.var_samp(c),
    "count": lambda c, at: F.count(c), "n_unique": lambda c, at: F.count_distinct(c), "first": _first, "last": _last,
    "median": None,
}
KNOWN_OPS = tuple(OPS)


def check_ops(agg_map: Mapping[str, Sequence[str]]) -> None:
    for col, ops in agg_map.items():
        for op in ops:
            if op not in OPS:
                raise ValueError(f"unknown aggregation {op!r} for {col!r}; known: {', '.join(KNOWN_OPS)}")


def summarise(df: DataFrame, keys: Sequence[str], agg_map: Mapping[str, Sequence[str]], at: str, name=None) -> DataFrame:
    """``groupBy(keys)`` with named aggregates; partial sums run map-side, medians through exact ranks."""
    check_ops(agg_map)
    name = name or (lambda c, op: f"{c}_{op}")
    plain = [(c, op) for c, ops in agg_map.items() for op in ops if op != "median"]
    medians = [c for c, ops in agg_map.items() if "median" in ops]
    exprs = [OPS[op](c, at).alias(name(c, op)) for c, op in plain]
    out = df.groupBy(*keys).agg(*exprs) if exprs else df.select(*keys).distinct()
    for c in medians:
        mid = exact_quantiles(df, keys, c, [0.5]).select(*keys, F.col("value").alias(name(c, "median")))
        out = out.join(mid, list(keys), "left")
    order = [name(c, op) for c, ops in agg_map.items() for op in ops]
    return out.select(*keys, *order)


def calendar_grid(df: DataFrame, keys: Sequence[str], ts_col: str, step: str, by_day_keys: bool = True) -> DataFrame:
    """Every step from the first to the last time of each key. Spans are cut by day first: no long arrays in a row."""
    width = period_seconds(step)
    span = df.groupBy(*keys).agg(F.min(ts_col).alias("_lo"), F.max(ts_col).alias("_hi"))
    return _explode_span(span, keys, ts_col, width)


def _explode_span(span: DataFrame, keys: Sequence[str], ts_col: str, width: int) -> DataFrame:
    chunk = max(width, 86400 * max(1, width // 86400))
    chunk -= chunk % width
    lo, hi = F.unix_micros("_lo"), F.unix_micros("_hi")
    blocks = span.where(F.col("_lo").isNotNull()).select(
        *keys, "_lo", "_hi", F.explode(F.sequence(lo, hi, F.lit(chunk * 1_000_000))).alias("_from")
    )
    upto = F.least(F.col("_from") + (chunk - width) * 1_000_000, F.unix_micros("_hi"))
    steps = F.explode(F.sequence(F.col("_from"), upto, F.lit(width * 1_000_000)))
    return blocks.select(*keys, steps.alias("_us")).select(*keys, F.timestamp_micros("_us").alias(ts_col))


def _calendar_steps(df: DataFrame, keys: Sequence[str], ts_col: str, unit: str) -> DataFrame:
    """Month, quarter and year starts between the first and last period."""
    text = {"mo": "1 month", "me": "1 month", "ms": "1 month", "q": "3 months", "y": "1 year", "w": "7 days"}[unit]
    span = df.groupBy(*keys).agg(F.min(ts_col).alias("_lo"), F.max(ts_col).alias("_hi"))
    return span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {text}"))).alias(ts_col))


def resample(
    df: DataFrame,
    period: str = "1h",
    agg_map: Mapping[str, Sequence[str]] | None = None,
    group_col: str = "stationid",
    datetime_col: str = "datetime",
    agg: Sequence[str] = DEFAULT_OPS,
    agg_vars: Sequence[str] | None = None,
    emit_empty: bool = False,
) -> DataFrame:
    """One row per group and period with ``{column}_{op}`` columns.

    ``emit_empty`` also gives the empty periods between a group's first and last one (sums and counts 0, rest null).
    """
    if agg_map is None:
        agg_map = {c: list(agg) for c in (agg_vars or [c for c in df.columns if c not in (group_col, datetime_col)])}
    agg_map = {c: ops for c, ops in agg_map.items() if c not in (group_col, datetime_col)}
    unknown = [c for c in agg_map if c not in df.columns]
    if unknown:
        raise ValueError(f"columns not found: {unknown}")
    keys = [group_col, datetime_col]
    cut = df.select(
        group_col, F.col(datetime_col).alias("_at"), period_start(datetime_col, period).alias(datetime_col), *agg_map
    )
    out = summarise(cut, keys, agg_map, "_at")
    if not emit_empty:
        return out
    n, unit = parse_period(period)
    calendar = unit in ("mo", "me", "ms", "q", "y", "w")
    grid = _calendar_steps(out, [group_col], datetime_col, unit) if calendar else calendar_grid(out, [group_col], datetime_col, period)
    full = grid.join(out, keys, "left")
    zero = [f"{c}_{op}" for c, ops in agg_map.items() for op in ops if op in ("sum", "count", "n_unique")]
    return full.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero}).select(out.columns)


def normalise_aggs(cols, funcs) -> list[tuple[str, str]]:
    """(column, function) pairs from a dict, equal lists, list x one, one x list, or one x one."""
    if isinstance(cols, Mapping):
        return [(c, f) for c, fs in cols.items() for f in ([fs] if isinstance(fs, str) else fs)]
    many_c, many_f = not isinstance(cols, str), not isinstance(funcs, str)
    if many_c and many_f:
        if len(cols) != len(funcs):
            raise ValueError(f"{len(cols)} columns but {len(funcs)} functions")
        return list(zip(cols, funcs))
    if many_c:
        return [(c, funcs) for c in cols]
    return [(cols, f) for f in funcs] if many_f else [(cols, funcs)]


def aggregate_time(df: DataFrame, date_col: str, freq: str, cols, funcs=None) -> DataFrame:
    """Series-wide summary per period, without a station key."""
    agg_map: dict[str, list[str]] = {}
    for c, f in normalise_aggs(cols, funcs):
        agg_map.setdefault(c, []).append(f)
    cut = df.select(F.col(date_col).alias("_at"), period_start(date_col, freq).alias(date_col), *agg_map)
    return summarise(cut, [date_col], agg_map, "_at")


def consolidate(df: DataFrame, ts_col: str, cols: Sequence[str], method: str) -> DataFrame:
    """One value per time over all stations; a sum over nothing but nulls is 0."""
    agg_map = {c: [method] for c in cols}
    out = summarise(df, [ts_col], agg_map, ts_col, name=lambda c, op: c)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols}) if method == "sum" else out


def regional_summary(df: DataFrame, ts_col: str, value: str) -> DataFrame:
    """Per time over stations: mean of known values, number reporting (>= 0) and number with rain (> 0)."""
    v = F.col(value)
    return df.groupBy(ts_col).agg(
        F.avg(v).alias("avg"), F.count_if(v >= 0).alias("cnt_ge0"), F.count_if(v > 0).alias("cnt_gt0")
    )


def max_by_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in df.columns if c not in keys])


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(col).agg(F.count("*").alias("count"))


def crosstab(df: DataFrame, a: str, b: str, b_values: Sequence) -> DataFrame:
    """Counts of ``a`` by ``b``; ``b_values`` lists the columns, so no job looks for them."""
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(f"{b}_{v}") for v in b_values])


def mean_ci(df: DataFrame, group: Sequence[str], col: str, div: float = 1.0) -> DataFrame:
    """Mean, count, sample deviation and 95 % interval with the count divided by ``div``."""
    half = 1.96 * F.col("std") / F.sqrt(F.col("count") / div)
    return (
        df.groupBy(*group).agg(F.avg(col).alias("mean"), F.count(col).alias("count"), F.stddev_samp(col).alias("std"))
        .withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half})
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``; a min over structs, so partial results shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    packed = F.min(F.struct(*lead, *[c for c in rest if c not in lead])).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[f"_row.{c}" for c in rest]).select(df.columns)


def series_profile(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slices) -> DataFrame:
    """Length, missing values and index (from 0) of the first known value of each series."""
    v = F.col(value)
    known = v.isNotNull() & ~F.isnan(v.cast("double"))
    numbered = with_ordinal(df, keys, order, slices)
    return numbered.groupBy(*keys).agg(
        F.count("*").alias("length"), F.count_if(~known).alias("missing"),
        F.min(F.when(known, F.col("pos") - 1)).alias("first_known"),
    )


def _copies(df: DataFrame, key: str) -> DataFrame:
    """Add ``_copy``: the number, from 1, of a row among those of its key, in the order of the values.

    Equal rows are counted before they move, and the rows of a key lie in even ranges of their values, so one key may
    hold any share of the rows.
    """
    cols = [c for c in df.columns if c != key]
    if not cols:
        return df.withColumn("_copy", F.lit(1).cast("long"))
    names = [F.col(f"`{c}`") for c in [key, *cols]]
    placed = ranged(df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), *names)
    begun = running_total(placed, [key], names[1:], [F.col("_range")], {"_before": F.col("_n")}, inclusive=False)
    # two steps, so that very many equal rows are no single array
    parts = begun.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(COPIES))))
    last = F.least(F.col("_part") + COPIES, F.col("_n"))
    return parts.select(*names, F.explode(F.sequence(F.col("_before") + F.col("_part") + 1, F.col("_before") + last)).alias("_copy"))


def align_sources(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """Every date of any source with each source's columns: one union and one aggregation, not a join chain.

    A date that a source has several times is kept that often, in the order of its values; the other sources' rows of
    that date go with the copies of the same number, so no value is lost and no choice is left to chance.
    """
    cols = [c for d in dfs for c in d.columns if c != key]
    if len(set(cols)) != len(cols):
        raise ValueError("sources share column names; rename them first")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_copies(d, key) for d in dfs])
    return stacked.groupBy(key, "_copy").agg(*[F.max(c).alias(c) for c in cols]).drop("_copy")


full_align = align_sources


def merge_aux(dfs: Sequence[DataFrame], key: str, station_col: str = "stationid") -> DataFrame:
    """Outer merge of auxiliary feature frames; frames without the key columns are skipped, clashing names kept once."""
    usable = [d for d in dfs if key in d.columns and station_col in d.columns]
    if len(usable) < len(dfs):
        logger.warning("%d auxiliary frames lack %s or %s and are skipped", len(dfs) - len(usable), key, station_col)
    if not usable:
        raise ValueError("no usable auxiliary frame")
    seen, parts = {key, station_col}, []
    for i, d in enumerate(usable):
        fresh = [c for c in d.columns if c not in seen]
        seen.update(fresh)
        parts.append(d.select(key, *([station_col] if i == 0 else []), *fresh))
    return align_sources(parts, key)

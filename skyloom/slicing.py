"""Ordered work on keys of any size.

``Window.partitionBy(key)`` sends all rows of a key to one task, which fails as soon as one key holds a large share
of the data. The helpers here cut every key into slices of its order, work inside a slice, and carry what has to
cross a slice border through a table that has one row per (key, slice):

* ``running_total`` / ``with_ordinal``: prefix sums and row numbers per key.
* ``sliced`` / ``row_frames``: copies of the border rows, so that a bounded frame sees all its rows in one slice.
* ``carry``: last known (or next known) values from earlier (or later) slices, for fills of any length.

Key and slice travel as one struct column: structs compare null-safe, and group, window and join then share a single
hash partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.session import cut_lineage

Cols = Sequence[str]
FIRST = -(2**40)  # slice of rows without an order value: before all others


def micros(col) -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "month": 30 * 86400, "year": 365 * 86400}


def time_slices(col: str, *units: str) -> list[Column]:
    """Slices of a timestamp column by span, coarse first. Raw readings want a fine last unit, resampled ones do not."""
    return [F.coalesce(F.floor(F.unix_seconds(F.col(col)) / _SECONDS[u]).cast("long"), F.lit(FIRST)) for u in units]


def hash_slices(col: str) -> list[Column]:
    """Even slices by the leading digits of an md5 text: 4,096, each cut into 4,096 more."""
    return [F.coalesce(F.substring(col, 1, n), F.lit("")) for n in (3, 6)]


def magnitude_slices(col: str) -> list[Column]:
    """Slices of a number by sign and binary magnitude: they follow any scale without looking at the data first."""
    x = F.col(col).cast("double")
    size = F.log2(F.abs(x)) + 1100
    level = lambda k: F.coalesce(
        F.when(x == 0, F.lit(0)).otherwise((F.signum(x) * F.floor(size * k))).cast("long"), F.lit(FIRST)
    )
    return [level(32), level(8192)]


def ranged(df: DataFrame, *order) -> DataFrame:
    """``df``, stored, with ``_range``: even slices of any order, cut at sampled values. Use it as ``F.col("_range")``."""
    return cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _group(keys: Cols, slices: Cols) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in [*keys, *slices]])


def _window(parts: Cols):
    return Window.partitionBy(_group(parts, [])) if parts else Window.partitionBy(F.lit(0))


def _starts(per_slice: DataFrame, keys: list[str], slices: list[str]) -> DataFrame:
    """Exclusive prefix sum of ``_total`` over slices, level by level: a level only numbers the slices of one parent."""
    parents = keys + slices[:-1]
    w = _window(parents).orderBy(slices[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inner = per_slice.withColumn("_before", F.coalesce(F.sum("_total").over(w), F.lit(0)))
    if len(slices) == 1:
        return inner
    upper = per_slice.groupBy(*parents).agg(F.sum("_total").alias("_total"))
    upper = _starts(upper, keys, slices[:-1]).select(_group(parents, []).alias("_parent"), F.col("_before").alias("_upper"))
    return (
        inner.withColumn("_parent", _group(parents, []))
        .join(upper, "_parent")
        .withColumn("_before", F.col("_before") + F.col("_upper"))
    )


def running_total(
    df: DataFrame,
    keys: Cols,
    order: Sequence[str | Column],
    slices: Sequence[Column],
    values: dict[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add columns: the sum of each value over all rows of the key up to this one in ``order``.

    ``slices`` never decrease along ``order`` (coarse first) and are not null. The order has to be total.
    """
    keys = list(keys)
    names = [f"_slice{i}" for i in range(len(slices))]
    inputs = {f"_value{i}": v for i, v in enumerate(values.values())}
    cut = df.withColumns({**dict(zip(names, slices)), **inputs}).withColumn("_g", _group(keys, names))
    sums = cut.groupBy("_g").agg(*[F.sum(v).alias(v) for v in inputs])
    starts = None
    for v in inputs:
        one = sums.select("_g.*", F.col(v).alias("_total"))
        one = _starts(one, keys, names).select(_group(keys, names).alias("_g"), F.col("_before").alias(f"_start{v}"))
        starts = one if starts is None else starts.join(one, "_g")
    end = 0 if inclusive else -1
    w = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    inside = cut.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_inside{v}") for v in inputs])
    out = inside.join(starts, "_g").withColumns(
        {name: F.col(f"_start{v}") + F.col(f"_inside{v}") for name, v in zip(values, inputs)}
    )
    return out.drop("_g", *names, *inputs, *[f"_inside{v}" for v in inputs], *[f"_start{v}" for v in inputs])


def with_ordinal(df: DataFrame, keys: Cols, order, slices, name: str = "pos") -> DataFrame:
    """Row number per key, from 1."""
    return running_total(df, keys, order, slices, {name: F.lit(1).cast("long")})


def sliced(df: DataFrame, pos: Column, length: int, before: int = 0, after: int = 0) -> DataFrame:
    """Give every row its slice of ``length`` positions and copy border rows to the slices whose frames need them.

    A frame reaches ``before`` positions back and ``after`` ahead. Rows with ``_own`` false are copies: compute the
    window over (key, ``_slice``), then keep ``_own`` rows (see ``own_rows``).
    """
    length = max(int(length), 2 * (before + after), 1)
    at = lambda c: F.floor(c / F.lit(length)).cast("long")
    if before == 0 and after == 0:
        return df.withColumns({"_slice": at(pos), "_own": F.lit(True)})
    return (
        df.withColumns({"_home": at(pos), "_slice": F.explode(F.sequence(at(pos - F.lit(after)), at(pos + F.lit(before))))})
        .withColumn("_own", F.col("_home") == F.col("_slice"))
        .drop("_home")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_slice")


def row_frames(df: DataFrame, keys: Cols, order, slices, before: int = 0, after: int = 0, length: int = 20_000):
    """Frame with ``pos`` and border copies, and the window to use on it (finish with ``own_rows``)."""
    frame = sliced(with_ordinal(df, keys, order, slices), F.col("pos"), length, before, after)
    return frame, Window.partitionBy(*keys, "_slice").orderBy("pos")


def carry(df: DataFrame, keys: Cols, order: str, slice_col: Column, cols: Cols, ahead: bool = False) -> DataFrame:
    """Add ``_prev_{c}`` (and ``_next_{c}`` with ``ahead``): struct(at, value) of the closest known ``c``, row included."""
    keys = list(keys)
    pack = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("value")))
    cut = df.withColumn("_cut", slice_col).withColumn("_g", _group(keys, ["_cut"]))
    edges = cut.groupBy("_g").agg(
        *[F.max(pack(c)).alias(f"_last_{c}") for c in cols], *([F.min(pack(c)).alias(f"_first_{c}") for c in cols] if ahead else [])
    ).select("_g", "_g.*", *[f"_last_{c}" for c in cols], *([f"_first_{c}" for c in cols] if ahead else []))
    outer = _window(keys).orderBy("_cut")
    inner = Window.partitionBy("_g").orderBy(order)
    back, front = outer.rowsBetween(Window.unboundedPreceding, -1), outer.rowsBetween(1, Window.unboundedFollowing)
    up, down = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(0, Window.unboundedFollowing)
    handed = [F.last(f"_last_{c}", ignorenulls=True).over(back).alias(f"_back_{c}") for c in cols]
    inside = [F.last(pack(c), ignorenulls=True).over(up).alias(f"_up_{c}") for c in cols]
    if ahead:
        handed += [F.first(f"_first_{c}", ignorenulls=True).over(front).alias(f"_front_{c}") for c in cols]
        inside += [F.first(pack(c), ignorenulls=True).over(down).alias(f"_down_{c}") for c in cols]
    joined = cut.select("*", *inside).join(edges.select("_g", *handed), "_g")
    new = {f"_prev_{c}": F.coalesce(f"_up_{c}", f"_back_{c}") for c in cols}
    if ahead:
        new |= {f"_next_{c}": F.coalesce(f"_down_{c}", f"_front_{c}") for c in cols}
    gone = [f"_{k}_{c}" for c in cols for k in (("up", "back", "down", "front") if ahead else ("up", "back"))]
    return joined.withColumns(new).drop("_g", "_cut", *gone)

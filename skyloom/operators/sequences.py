"""Sequence preparation: windows, chunks, shifts, pooling, scaling. Long keys are cut into slices, never held whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.functions.calendar import time_features
from skyloom.operators.reshape import seeded_hash
from skyloom.slicing import own_rows, row_frames, running_total, with_ordinal


def every_kth(df: DataFrame, keys: Sequence[str], order, k: int, slices) -> DataFrame:
    """Rows 0, k, 2k, ... of each sequence."""
    return with_ordinal(df, keys, order, slices, "_no").where((F.col("_no") - 1) % k == 0).drop("_no")


def every_kth_item(arr, k: int) -> Column:
    return F.filter(F.col(arr) if isinstance(arr, str) else arr, lambda _, i: i % k == 0)


def forecast_windows(
    df: DataFrame, keys: Sequence[str], order, cols: Sequence[str], target: str, seq_len: int, pred_len: int, slices,
    label_len: int = 0, ts_col: str | None = None, freq: str = "h", scaled_time: bool = False, eval_stamp: bool = False,
    eval_mask: bool = False,
) -> DataFrame:
    """One row per full window: ``seq_x`` (structs, then ``pred_len`` zeros), ``seq_y``, ``mark``, ``mask``.

    The row is the last input; ``seq_y`` starts ``label_len`` rows before the forecast. There are
    ``n - seq_len - pred_len + 1`` windows per sequence.
    """
    frame, w = row_frames(df, keys, order, slices, before=seq_len, after=pred_len)
    past, ahead = w.rowsBetween(-(seq_len - 1), 0), w.rowsBetween(1 - label_len, pred_len)
    box = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in cols])
    zero = F.struct(*[F.lit(0.0).alias(c) for c in cols])
    made = {
        "_x": F.collect_list(box).over(past),
        "_y": F.collect_list(F.struct(F.col(target).alias("v"))).over(ahead),
        "start_pos": F.col("pos") - seq_len + 1,
    }
    if ts_col:
        parts = F.array(*[c.cast("double") for c in time_features(ts_col, freq, scaled_time).values()])
        made["_mark"] = F.collect_list(parts).over(w.rowsBetween(-(seq_len - 1), pred_len if eval_stamp else 0))
    out = own_rows(frame.withColumns(made)).where((F.size("_x") == seq_len) & (F.size("_y") == pred_len + label_len))
    final = {
        "seq_x": F.concat("_x", F.array_repeat(zero, pred_len)),
        "seq_y": F.transform("_y", lambda s: s["v"]),
        "mask": F.concat(F.array_repeat(F.lit(0), seq_len), F.array_repeat(F.lit(1 if eval_mask else 0), pred_len)),
    }
    if ts_col:
        blank = F.transform(F.col("_mark")[0], lambda x: x * 0.0)
        final["mark"] = F.col("_mark") if eval_stamp else F.concat("_mark", F.array_repeat(blank, pred_len))
    return out.withColumns(final).drop("_x", "_y", "_mark", "pos")


def chunk(df: DataFrame, keys: Sequence[str], order, value: str, length: int, slices, drop_last: bool = True) -> DataFrame:
    """Arrays of ``length`` values in order; the short tail is dropped or kept."""
    numbered = with_ordinal(df.select(*keys, *_names(order), value), keys, order, slices)
    cut = numbered.withColumn("chunk", F.floor((F.col("pos") - 1) / length).cast("long"))
    out = cut.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("_c"))
    out = out.withColumn("values", F.transform("_c", lambda s: s["v"])).drop("_c")
    return out.where(F.size("values") == length) if drop_last else out


def chunk_length(length: int, rate_in: int, rate_out: int) -> int:
    """Chunk length after a change of the sampling rate."""
    return int(length * rate_out / rate_in)


def _names(order) -> list[str]:
    if not all(isinstance(c, str) for c in order):
        raise ValueError("give the order as column names")
    return list(order)


def next_step_pairs(df: DataFrame, keys: Sequence[str], order, value: str, fill, slices) -> DataFrame:
    """``input`` is the value one step earlier (``fill`` at the start), ``target`` the value itself."""
    frame, w = row_frames(df, keys, order, slices, before=1)
    pairs = frame.withColumns({"input": F.lag(value, 1).over(w), "target": F.col(value)})
    return own_rows(pairs).withColumn("input", F.when(F.col("pos") == 1, F.lit(fill)).otherwise(F.col("input"))).drop("pos")


def shift_array(arr, fill) -> Column:
    """A whole array shifted right by one, the first place filled."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.concat(F.array(F.lit(fill)), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))


def trim_context(arr, context_len: int) -> Column:
    """The last ``context_len`` entries."""
    a = F.col(arr) if isinstance(arr, str) else arr
    keep = F.least(F.size(a), F.lit(context_len))
    return F.slice(a, F.size(a) - keep + 1, keep)


def pool_sequence(df: DataFrame, keys: Sequence[str], order, value: str, mode: str, slices, l_output: int | None = None,
                  lengths: DataFrame | None = None) -> DataFrame:
    """Rows of each sequence after pooling.

    ``last``/``first``: that many rows at the end or start; ``pool``/``sum``: running mean or sum, last ``l_output``
    rows; ``ragged``: the first ``length`` rows, from a frame (keys, ``length``).
    """
    if mode in ("pool", "sum"):
        numbered = running_total(
            df, keys, order, slices, {"pos": F.lit(1).cast("long"), "_total": F.col(value).cast("double")}
        ).withColumn("pooled", F.col("_total") / F.col("pos") if mode == "pool" else F.col("_total")).drop("_total")
    else:
        numbered = with_ordinal(df, keys, order, slices).withColumn("pooled", F.col(value))
    if mode == "ragged":
        return numbered.join(lengths, list(keys)).where(F.col("pos") <= F.col("length")).drop("pos", "length")
    if mode == "first":
        return numbered.where(F.col("pos") <= (l_output or 1)).drop("pos")
    if mode not in ("last", "pool", "sum"):
        raise ValueError(f"unknown mode {mode!r}")
    if l_output is None and mode != "last":
        return numbered.drop("pos")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return numbered.join(sizes, list(keys)).where(F.col("pos") > F.col("_n") - (l_output or 1)).drop("pos", "_n")


def overlap_chunks(df: DataFrame, keys: Sequence[str], order, value: str, chunk_len: int, overlap_len: int, slices, zero=0) -> DataFrame:
    """Chunks of ``chunk_len`` new values behind the last ``overlap_len - 1`` values of the chunk before.

    The first chunk is led by ``zero`` values and has ``reset`` true; the last, possibly short, chunk of a sequence is
    left out, as no full step follows it.
    """
    lead = max(overlap_len - 1, 0)
    numbered = with_ordinal(df.select(*keys, *_names(order), value), keys, order, slices)
    place = F.col("pos") - 1
    home = F.floor(place / chunk_len).cast("long")
    reach = F.floor((place + lead) / chunk_len).cast("long")
    copies = numbered.withColumn("chunk", F.explode(F.sequence(home, reach)))
    out = copies.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("_c"))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    # starts 0, L, 2L, ... below the sequence length, the last one dropped
    out = out.join(sizes, list(keys)).where(F.col("chunk") < F.ceil(F.col("_n") / chunk_len) - 1)
    values = F.transform("_c", lambda s: s["v"])
    padded = F.when(F.col("chunk") == 0, F.concat(F.array_repeat(F.lit(zero).cast(df.schema[value].dataType), lead), values)).otherwise(values)
    return out.select(*keys, "chunk", padded.alias("values"), (F.col("chunk") == 0).alias("reset"))


def ema(df: DataFrame, keys: Sequence[str], order, col: str, p: float, alpha: float, l_max: int, slices, name: str = "ema") -> DataFrame:
    """Damped moving average: weights ``p * q**l`` with ``q = 1 - p * alpha`` over the last ``l_max`` values."""
    q = 1 - p * alpha
    frame, w = row_frames(df, keys, order, slices, before=l_max)
    recent = F.reverse(F.collect_list(F.struct(F.col(col).cast("double").alias("v"))).over(w.rowsBetween(-(l_max - 1), 0)))
    weighted = F.transform(recent, lambda s, i: F.coalesce(s["v"], F.lit(0.0)) * F.lit(p) * F.pow(F.lit(q), i.cast("double")))
    total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return own_rows(frame.withColumn(name, total)).drop("pos")


def downsample(df: DataFrame, keys: Sequence[str], order, value: str, stride: int, slices, how: str = "pick") -> DataFrame:
    """Every ``stride``-th row, or the mean of each full block of ``stride`` rows."""
    numbered = with_ordinal(df.select(*keys, *_names(order), value), keys, order, slices)
    block = F.floor((F.col("pos") - 1) / stride).cast("long")
    if how == "pick":
        return numbered.where((F.col("pos") - 1) % stride == 0).withColumn("block", block).select(*keys, "block", value)
    if how != "mean":
        raise ValueError("how is 'pick' or 'mean'")
    out = numbered.withColumn("block", block).groupBy(*keys, "block").agg(F.avg(value).alias(value), F.count("*").alias("_n"))
    return out.where(F.col("_n") == stride).drop("_n")


def top_k_per_class(df: DataFrame, cls: str, score: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The ``k`` most confident rows of each class; the limit also runs before the shuffle."""
    w = Window.partitionBy(cls).orderBy(F.col(score).desc(), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def random_k_per_class(df: DataFrame, cls: str, k: int, seed: int, id_cols: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(cls).orderBy("_h", *id_cols)
    hashed = df.withColumn("_h", seeded_hash(id_cols, seed))
    return hashed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn", "_h")


def circular_shift(df: DataFrame, keys: Sequence[str], order, seed: int, slices, name: str = "shifted_pos") -> DataFrame:
    """New place (from 0) of each row after rotating its sequence left by a seeded amount."""
    numbered = with_ordinal(df, keys, order, slices)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    shift = F.conv(F.substring(seeded_hash(keys, seed), 1, 8), 16, 10).cast("long") % F.col("_n")
    out = numbered.join(sizes, list(keys))
    return out.withColumn(name, F.pmod(F.col("pos") - 1 - shift, F.col("_n"))).drop("_n", "pos")


def drop_points(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str], rate: float, seed: int) -> DataFrame:
    """Blank a seeded share of the points: value 0 and a presence mask per column."""
    made = {}
    for c in cols:
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in id_cols], F.lit(c), F.lit(str(seed)))), 1, 8), 16, 10)
        present = draw.cast("double") / 4294967296.0 >= rate
        made |= {c: F.when(present, F.col(c)).otherwise(0.0), f"{c}_present": present.cast("int")}
    return df.withColumns(made)


# --- scaling -------------------------------------------------------------------------------------------------------
def fit_scaler(df: DataFrame, cols: Sequence[str], where: Column | str | None = None, ddof: int = 0) -> DataFrame:
    """One row with mean and deviation per column, from the chosen (training) rows; NaN counts as missing."""
    rows = df.where(where) if where is not None else df
    dev = F.stddev_samp if ddof else F.stddev_pop
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return rows.agg(*[F.avg(clean(c)).alias(f"{c}_mean") for c in cols], *[dev(clean(c)).alias(f"{c}_std") for c in cols])


def _stat(stats: DataFrame) -> Column:
    return stats.select(F.struct(*stats.columns)).scalar()


def scale(df: DataFrame, cols: Sequence[str], stats: DataFrame, eps: float = 0.0) -> DataFrame:
    s = F.col("_stats")
    out = df.withColumn("_stats", _stat(stats))
    return out.withColumns({c: (F.col(c) - s[f"{c}_mean"]) / (s[f"{c}_std"] + eps) for c in cols}).drop("_stats")


def unscale(df: DataFrame, cols: Sequence[str], stats: DataFrame, eps: float = 0.0) -> DataFrame:
    s = F.col("_stats")
    out = df.withColumn("_stats", _stat(stats))
    return out.withColumns({c: F.col(c) * (s[f"{c}_std"] + eps) + s[f"{c}_mean"] for c in cols}).drop("_stats")


def fit_global_scaler(df: DataFrame, array_col: str, where: Column | str | None = None) -> DataFrame:
    """One mean and population deviation over all entries of all (training) arrays."""
    rows = df.where(where) if where is not None else df
    x = rows.select(F.explode(array_col).alias("x"))
    return x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def scale_arrays(df: DataFrame, array_col: str, stats: DataFrame) -> DataFrame:
    s = F.col("_stats")
    out = df.withColumn("_stats", _stat(stats))
    return out.withColumn(array_col, F.transform(array_col, lambda x: (x - s["mean"]) / s["std"])).drop("_stats")


def minmax(df: DataFrame, keys: Sequence[str], col: str, lo: float = 0.0, hi: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """Per-sequence scaling to [lo, hi]; ranges are partial aggregates joined back by key."""
    span = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    x = lo + (hi - lo) * (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)
    return df.join(span, list(keys)).withColumn(col, x).drop("_lo", "_hi")

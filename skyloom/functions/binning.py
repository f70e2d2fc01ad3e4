"""Interval bins with an explicit closing side and an explicit rule for values outside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def bin_col(col, bins: Sequence[float], labels: Sequence, *, closed: str, outside: str) -> Column:
    """Label of the interval that holds ``col``.

    ``closed="left"`` means [a, b), ``"right"`` means (a, b]. ``outside="null"`` gives null for values in no interval,
    ``"last"`` gives them (and nulls) the last label.
    """
    if len(labels) != len(bins) - 1:
        raise ValueError(f"{len(bins)} edges need {len(bins) - 1} labels, got {len(labels)}")
    if list(bins) != sorted(bins):
        raise ValueError("bin edges must increase")
    if closed not in ("left", "right") or outside not in ("null", "last"):
        raise ValueError("closed is 'left' or 'right'; outside is 'null' or 'last'")
    x = F.col(col) if isinstance(col, str) else col
    known = x.isNotNull() & ~F.isnan(x.cast("double"))
    out = None
    for low, high, label in zip(bins, bins[1:], labels):
        low, high = F.lit(float(low)), F.lit(float(high))
        inside = known & ((x >= low) & (x < high) if closed == "left" else (x > low) & (x <= high))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out.otherwise(F.lit(labels[-1])) if outside == "last" else out


def binary_target(col, threshold: float = 0.5) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    return F.when(x <= threshold, F.lit(0)).when(x.isNotNull(), F.lit(1))


def cut_and_label(df: DataFrame, variable: str, bins, labels, name: str = "label") -> DataFrame:
    """Binned copy of ``variable`` as first column; values in no interval get the last label."""
    rest = [c for c in df.columns if c != name]
    return df.select(bin_col(variable, bins, labels, closed="left", outside="last").alias(name), *rest)


def histogram(df: DataFrame, col: str, bins: int = 50, density: bool = True) -> DataFrame:
    """Equal-width histogram over the observed range; the last bin includes the maximum."""
    known = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    span = known.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    idx = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width))).otherwise(0)
    placed = known.withColumn("_s", span.select(F.struct("lo", "hi")).scalar()).select("x", "_s.lo", "_s.hi")
    counted = placed.groupBy(idx.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    every = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    height = F.col("count") / (F.col("n") * width) if density else F.col("count").cast("double")
    return out.select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), "count", height.alias("height")
    )


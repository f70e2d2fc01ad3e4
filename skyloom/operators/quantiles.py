"""Exact quantiles without holding a group's values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skyloom.slicing import magnitude_slices, running_total


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per key: columns ``keys``, ``prob``, ``value``.

    Rows are first counted per distinct value; ranks come from sliced running counts, so a huge group is spread over
    many tasks and only the values at the wanted ranks are kept.
    """
    keys = list(keys)
    x = F.col(col).cast("double")
    counted = (
        df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, x.alias("_x")).agg(F.count("*").alias("_n"))
    )
    ranked = running_total(counted, keys, ["_x"], magnitude_slices("_x"), {"_upto": F.col("_n")})
    if keys:
        totals = counted.groupBy(F.struct(*keys).alias("_k")).agg(F.sum("_n").alias("_all"))
        ranked = ranked.withColumn("_k", F.struct(*keys)).join(totals, "_k")
    else:
        ranked = ranked.withColumns({"_k": F.lit(0), "_all": counted.agg(F.sum("_n")).scalar()})
    want = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), ((F.col("_all") - 1) * float(p)).alias("at")) for p in probs
    ])
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    # a distinct value covers ranks first..last; keep it for every wanted rank whose floor or ceiling it covers
    covers = lambda r: (F.col("_first") <= r) & (r <= F.col("_last"))
    wanted = F.filter(want, lambda w: covers(F.floor(w["at"])) | covers(F.ceil(w["at"])))
    hits = ranked.withColumns({"_first": first, "_last": last}).select("_k", "_x", "_first", "_last", F.explode(wanted).alias("_w"))
    hits = hits.select("_k", "_x", "_first", "_last", F.col("_w.prob").alias("prob"), F.col("_w.at").alias("_at"))
    lo, hi = F.floor("_at"), F.ceil("_at")
    out = hits.groupBy("_k", "prob", "_at").agg(
        F.max(F.when(covers(lo), F.col("_x"))).alias("_lo"), F.max(F.when(covers(hi), F.col("_x"))).alias("_hi")
    ).withColumn("value", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at")))
    picked = out.select(*([f"_k.{k}" for k in keys]), "prob", "value")
    return picked


def quantile_edges(df: DataFrame, col: str, q: int) -> DataFrame:
    """Edges that cut the positive values into ``q`` parts of equal count: columns ``edge_no``, ``edge``."""
    edges = exact_quantiles(df.where(F.col(col) > 0), [], col, [i / q for i in range(q + 1)])
    return edges.select(F.round(F.col("prob") * q).cast("int").alias("edge_no"), F.col("value").alias("edge"))


def quantile_bin(df: DataFrame, col: str, q: int, name: str = "bin") -> DataFrame:
    """Quantile class of every row, right-closed, the lowest edge included; 0 stays a class of its own (0)."""
    edges = quantile_edges(df, col, q).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("edge_no", "edge"))), lambda e: e["edge"])
    )  # one array of q + 1 numbers
    x = F.col(col)
    above = F.size(F.filter(F.slice("_edges", 2, q), lambda e: e < x))
    cls = F.when(x == 0, 0).when((x >= F.col("_edges")[0]) & (x <= F.col("_edges")[q]), above + 1)
    return df.withColumn("_edges", edges.scalar()).withColumn(name, cls.cast("int")).drop("_edges")

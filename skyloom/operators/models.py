"""Models as Spark jobs: weight-of-evidence bins, logistic fits, batch scoring, a per-station baseline forecast."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skyloom.operators.quantiles import exact_quantiles
from skyloom.session import cut_lineage
from skyloom.slicing import own_rows, row_frames


# --- weight of evidence --------------------------------------------------------------------------------------------
def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _evidence(n: Column, pos: Column) -> tuple[Column, Column]:
    """(weight of evidence, part of the information value) of a bin with ``n`` rows, ``pos`` of them positive."""
    p = F.greatest(pos, F.lit(0.5)) / F.greatest("_pos", F.lit(1))
    q = F.greatest(n - pos, F.lit(0.5)) / F.greatest(F.col("_n") - F.col("_pos"), F.lit(1))
    woe = F.log(p / q)
    return woe, (p - q) * woe


def _merge_step(bins: Column, min_total: float, min_class: float, stop_limit: float) -> Column:
    """Bins after one merge of two neighbours; the same bins if nothing is left to merge.

    The first bin that is too small goes to the side with the nearer evidence. Once none is too small, the two whose
    merging costs least information merge, unless that is more than ``stop_limit`` of all; two bins always stay.
    Equal choices (to 12 digits) go to the lower bins.
    """

    def weighed(b: Column) -> Column:
        woe, iv = _evidence(b["n"], b["pos"])
        neg, all_neg = b["n"] - b["pos"], F.col("_n") - F.col("_pos")
        small = (b["n"] < min_total * F.col("_n")) | (b["pos"] < min_class * F.col("_pos")) | (neg < min_class * all_neg)
        return F.struct(b["hi"].alias("hi"), b["n"].alias("n"), b["pos"].alias("pos"), woe.alias("woe"), iv.alias("iv"), small.alias("small"))

    def joined(a: Column, b: Column) -> Column:
        return F.struct(b["hi"].alias("hi"), (a["n"] + b["n"]).alias("n"), (a["pos"] + b["pos"]).alias("pos"))

    def merged(bs: Column) -> Column:
        size = F.size(bs)
        at = F.array_position(F.transform(bs, lambda b: b["small"]), True)  # from 1; 0: no bin is too small

        def pair(i: Column) -> Column:  # bins i and i + 1, from 1
            a, b = F.get(bs, i - 1), F.get(bs, i)
            cost = a["iv"] + b["iv"] - _evidence(a["n"] + b["n"], a["pos"] + b["pos"])[1]
            return F.struct(F.round(F.when(at > 0, F.abs(a["woe"] - b["woe"])).otherwise(cost), 12).alias("cost"), i.alias("i"))

        beside = lambda i: (at == 0) | (i == at) | (i == at - 1)
        best = F.array_min(F.transform(F.filter(F.sequence(F.lit(1), size - 1), beside), pair))
        total = F.aggregate(bs, F.lit(0.0), lambda acc, b: acc + b["iv"])
        plain = F.transform(bs, lambda b: F.struct(b["hi"].alias("hi"), b["n"].alias("n"), b["pos"].alias("pos")))

        def apply(x: Column) -> Column:
            goes = (at > 0) | ((size > 2) & (total > 0) & (x["cost"] <= stop_limit * total))
            one = F.array(joined(F.get(bs, x["i"] - 1), F.get(bs, x["i"])))
            return F.when(goes, F.concat(F.slice(plain, F.lit(1), x["i"] - 1), one, F.slice(plain, x["i"] + 2, size))).otherwise(plain)

        return F.when(size > 1, _let(best, apply)).otherwise(plain)

    return _let(F.transform(bins, weighed), merged)


def woe_fit(df: DataFrame, target: str, cols: Sequence[str], min_total: float = 0.05, min_class: float = 0.001,
            stop_limit: float = 0.1) -> DataFrame:
    """Bins per variable: (var, bin, is_missing, hi, n, pos, woe, iv); the last known bin is open above (``hi`` null).

    Start bins hold ``min_total`` of the rows each; only their counts (at most 1 / min_total per variable) are merged,
    as a fold over one short array per variable. Missing values are a bin of their own, rows without a target count as
    not positive, and a variable without any value has that one bin only. The fitted bins are stored, so that applying
    them does not fit again.
    """
    long = df.select(target, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([target], list(cols), "var", "x")
    steps = int(1 / min_total)
    edges = exact_quantiles(long, ["var"], "x", [i / steps for i in range(1, steps)]).groupBy("var").agg(
        F.sort_array(F.collect_set("value")).alias("edges")
    )  # one short array per column
    hi = F.get("edges", F.col("bin"))
    binned = long.join(F.broadcast(edges), "var", "left").withColumn(
        "bin", F.when(F.col("x").isNull() | F.isnan("x"), -1).otherwise(F.size(F.filter("edges", lambda e: e < F.col("x"))))
    )
    counts = binned.groupBy("var", "bin", hi.alias("hi")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col(target).cast("long")), F.lit(0)).cast("long").alias("pos")
    )
    listed = counts.groupBy("var").agg(  # at most steps + 1 counts per column
        F.sum("n").alias("_n"), F.sum("pos").alias("_pos"), F.array_sort(F.collect_list(F.struct("bin", "hi", "n", "pos"))).alias("_all")
    )
    of = lambda cond: F.transform(F.filter("_all", cond), lambda b: F.struct(b["hi"].alias("hi"), b["n"].alias("n"), b["pos"].alias("pos")))
    step = lambda bs, _: _merge_step(bs, min_total, min_class, stop_limit)
    known = listed.withColumns({"_missing": of(lambda b: b["bin"] < 0), "_known": of(lambda b: b["bin"] >= 0)}).withColumn(
        "_known", F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("_known"), F.lit(1))), F.col("_known"), step)
    )
    rows = known.select("var", "_n", "_pos", F.size("_known").alias("_size"), F.posexplode(F.concat("_known", "_missing")).alias("bin", "b"))
    woe, iv = _evidence(F.col("b.n"), F.col("b.pos"))
    bins = rows.select(
        "var", "bin", (F.col("bin") >= F.col("_size")).alias("is_missing"), F.when(F.col("bin") < F.col("_size") - 1, F.col("b.hi")).alias("hi"),
        "b.n", "b.pos", woe.alias("woe"), F.sum(iv).over(Window.partitionBy("var")).alias("iv"),
    )
    return cut_lineage(bins)


def woe_select(bins: DataFrame, cutoff: float = 0.4) -> DataFrame:
    """Variables whose information value reaches the cutoff."""
    return bins.where(F.col("iv") >= cutoff).select("var", "iv").distinct()


def woe_apply(df: DataFrame, bins: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``{col}_woe``; the bin list of a column is a short literal array."""
    out = df
    for c in cols:
        own = bins.where(F.col("var") == c)
        listed = own.agg(F.array_sort(F.collect_list(F.struct("bin", "is_missing", "hi", "woe")))).scalar()
        x = F.col(c).cast("double")
        missing = F.col(c).isNull() | F.isnan(x)
        inside = lambda b: ~b["is_missing"] & (b["hi"].isNull() | (x <= b["hi"]))
        fits = F.filter("_bins", lambda b: F.when(missing, b["is_missing"]).otherwise(inside(b)))
        out = out.withColumn("_bins", listed).withColumn(f"{c}_woe", F.get(fits, F.lit(0))["woe"]).drop("_bins")
    return out


# --- logistic ------------------------------------------------------------------------------------------------------
def fit_logistic(df: DataFrame, label: str, cols: Sequence[str], family: str = "auto", max_iter: int = 50):
    """Fitted (assembler, logistic) stages; rows with missing values are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="_features", handleInvalid="skip"),
        LogisticRegression(featuresCol="_features", labelCol=label, family=family, maxIter=max_iter),
    ]
    return Pipeline(stages=stages).fit(df.dropna(subset=[label, *cols]).withColumn(label, F.col(label).cast("double")))


def predict_logistic(df: DataFrame, model, keep: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df.withColumn(model.stages[-1].getLabelCol(), F.col(model.stages[-1].getLabelCol()).cast("double")))
    return out.select(*keep, F.col("prediction").cast("int").alias("Predicted"), vector_to_array("probability").alias("probs"))


# --- scoring -------------------------------------------------------------------------------------------------------
def score(df: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], cols: Sequence[str], modeltype: str = "classification") -> DataFrame:
    """Every row with its prediction: class, probability and class probabilities, or a value.

    ``scorer`` maps a (rows, columns) array to class logits (one column means a binary logit) or to values. It travels
    to the executors once per task; inputs stay in their row, so nothing has to be matched up afterwards.
    """
    cols = list(cols)
    extra = "Predicted double" if modeltype == "regression" else "Predicted int, Probability double, probs array<double>"
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(extra).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.asarray(scorer(pdf[cols].to_numpy(dtype="float64")), dtype="float64")
            if modeltype == "regression":
                yield pdf.assign(Predicted=out.reshape(len(pdf)))
                continue
            out = out.reshape(len(pdf), -1)
            if out.shape[1] == 1:
                p1 = 1 / (1 + np.exp(-out[:, 0]))
                probs = np.stack([1 - p1, p1], axis=1)
            else:
                exps = np.exp(out - out.max(axis=1, keepdims=True))
                probs = exps / exps.sum(axis=1, keepdims=True)
            yield pdf.assign(Predicted=probs.argmax(axis=1).astype("int32"), Probability=probs.max(axis=1), probs=list(probs))

    return df.mapInPandas(run, schema)


# --- baseline forecast ---------------------------------------------------------------------------------------------
def ar1_forecast(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, slices, train_share: float = 0.8) -> DataFrame:
    """First-order autoregression per series: fitted on the first part, run on from its last value over the rest.

    Rows of the rest come back as (keys, order, ``step``, ``actual``, ``forecast``).
    """
    frame, w = row_frames(df.select(*keys, *order, col), keys, order, slices, before=1)
    lagged = own_rows(frame.withColumn("_lag", F.lag(col).over(w)))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = lagged.join(sizes, list(keys)).withColumn("_t", F.floor(F.col("_n") * train_share + 1e-9).cast("long"))
    train = F.col("pos") <= F.col("_t")
    y, x = F.when(train, F.col(col)), F.when(train, F.col("_lag"))
    fit = rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.max(F.when(F.col("pos") == F.col("_t"), F.col(col))).alias("_last")
    )
    h = (F.col("pos") - F.col("_t")).cast("double")
    power = F.pow("_b", h)
    drift = F.when(F.abs(1 - F.col("_b")) < 1e-12, h).otherwise((1 - power) / (1 - F.col("_b")))
    return rows.where(~train).join(fit, list(keys)).select(
        *keys, *order, h.cast("long").alias("step"), F.col(col).alias("actual"), (power * F.col("_last") + F.col("_a") * drift).alias("forecast")
    )


# --- cells ---------------------------------------------------------------------------------------------------------
def assign_cells(df: DataFrame, col: str, centres: DataFrame) -> DataFrame:
    """Add ``cell``: the nearest of a short list of centres (``cell``, ``centre``), ties to the smaller number."""
    listed = centres.agg(F.collect_list(F.struct("cell", F.col("centre").cast("array<double>").alias("centre")))).scalar()
    x = F.col(col).cast("array<double>")
    far = lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)
    ranked = F.transform("_centres", lambda c: F.struct(F.round(far(c["centre"]), 12).alias("d"), c["cell"].alias("cell")))
    return df.withColumn("_centres", listed).withColumn("cell", F.array_min(ranked)["cell"]).drop("_centres")


def lloyd_step(df: DataFrame, col: str, centres: DataFrame) -> DataFrame:
    """New (``cell``, ``centre``): the mean of the vectors nearest to each centre; empty cells are left out."""
    entries = assign_cells(df, col, centres).select("cell", F.posexplode(col).alias("i", "x"))
    means = entries.groupBy("cell", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))

"""Classification, ranking, regression and sample-quality measures as DataFrame jobs.

Every measure first shrinks the rows to counts or sums (partial aggregates); only those small tables are reshaped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyloom.functions import arrays as ar
from skyloom.operators.reshape import seeded_hash
from skyloom.slicing import hash_slices, magnitude_slices, running_total, with_ordinal


def _share(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


# --- confusion counts ----------------------------------------------------------------------------------------------
def pair_counts(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, errors_only: bool = False, labels: Sequence | None = None,
                     all_pairs: bool = True) -> DataFrame:
    """Count of every (actual, predicted) pair, zeros included.

    The pairs are those of the given ``labels``, and rows with another label, or none, are left out. Without them all
    labels of the data are paired, which is for few labels: with many, ``all_pairs=False`` gives the pairs that occur,
    and no list of labels is made. ``errors_only`` counts hits as zero, or leaves them out where only seen pairs come.
    """
    if labels is not None:
        wanted = list(dict.fromkeys(labels))
        df = df.where(F.col(actual).isin(wanted) & F.col(predicted).isin(wanted))
    counts = pair_counts(df, actual, predicted)
    shown = counts.where(~F.col("actual").eqNullSafe(F.col("predicted"))) if errors_only else counts
    if not all_pairs:
        return shown
    if labels is not None:
        kind = df.schema[actual].dataType.simpleString()
        listed = df.sparkSession.range(1).select(F.array(*[F.lit(x) for x in wanted]).cast(f"array<{kind}>").alias("labels"))
    else:
        seen = counts.select(F.explode(F.array("actual", "predicted")).alias("l"))
        listed = seen.agg(F.sort_array(F.collect_set("l")).alias("labels"))
    every = listed.select("labels", F.explode("labels").alias("actual")).select("actual", F.explode("labels").alias("predicted"))
    return every.join(shown, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _class_counts(df: DataFrame, actual: str, predicted: str, by: Sequence[str]) -> DataFrame:
    counts = pair_counts(df, actual, predicted, by)
    hit = F.col("actual") == F.col("predicted")
    n, zero = F.col("n"), F.lit(0).cast("long")
    side = lambda label, tp, fn, fp: F.struct(F.col(label).alias("label"), tp.alias("tp"), fn.alias("fn"), fp.alias("fp"))
    sides = F.array(
        side("actual", F.when(hit, n).otherwise(zero), F.when(~hit, n).otherwise(zero), zero),
        side("predicted", zero, zero, F.when(~hit, n).otherwise(zero)),
    )
    per_class = counts.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.label").agg(
        F.sum("s.tp").alias("tp"), F.sum("s.fn").alias("fn"), F.sum("s.fp").alias("fp")
    )
    sums = [F.sum("n").alias("total"), F.sum(F.when(hit, n).otherwise(zero)).alias("hits")]
    if by:
        totals = counts.groupBy(F.struct(*by).alias("_k")).agg(*sums)
        out = per_class.withColumn("_k", F.struct(*by)).join(totals, "_k").drop("_k")
    else:
        whole = counts.agg(*sums).select(F.struct("total", "hits")).scalar()
        out = per_class.withColumn("_t", whole).select(*per_class.columns, "_t.total", "_t.hits")
    return out.withColumn("tn", F.col("total") - F.col("tp") - F.col("fn") - F.col("fp"))


def class_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class: precision, recall, specificity, rates, F1, balanced accuracy, support, overall accuracy (4 places)."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    precision, recall, specificity = _share(tp, tp + fp), _share(tp, tp + fn), _share(tn, tn + fp)
    r = lambda c: F.round(c, 4)
    return _class_counts(df, actual, predicted, by).select(
        *by, "label", r(precision).alias("precision"), r(recall).alias("recall"), r(specificity).alias("specificity"),
        r(recall).alias("tpr"), r(_share(fp, fp + tn)).alias("fpr"), r(_share(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        r((recall + specificity) / 2).alias("balanced_accuracy"), (tp + fn).alias("support"),
        r(_share(F.col("hits"), F.col("total"))).alias("accuracy"),
    )


def tidy_metrics(metrics: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Metric table in long form."""
    names = [c for c in metrics.columns if c not in ids]
    return metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(ids), names, "metric", "value")


def mismatches(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.where(F.col(actual) != F.col(predicted))


def error_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return mismatches(df, actual, predicted).groupBy(actual).agg(F.count("*").alias("errors"))


def correct_share(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    hit = (F.col(actual) == F.col(predicted)).cast("double")
    return df.groupBy(actual).agg(F.avg(hit).alias("correct"), (1 - F.avg(hit)).alias("incorrect"))


def binary_summary(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Zero against the rest: counts, precision, recall, specificity, accuracy."""
    a, p = F.col(actual) != 0, F.col(predicted) != 0
    counts = df.groupBy(*by).agg(
        F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "specificity": _share(tn, tn + fp),
        "accuracy": _share(tp + tn, tp + tn + fp + fn),
    })


def threshold_grid(df: DataFrame, value: str, prob: str, actual_ts: Sequence[float], prob_ts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall for every pair of thresholds (``value >= ta`` is true, ``prob >= tp`` predicted).

    Rows are counted once per pair of threshold steps; the grid is summed from those few counts.
    """
    step = lambda c, ts: sum((F.col(c) >= float(x)).cast("int") for x in sorted(ts))
    counts = df.where(F.col(value).isNotNull() & F.col(prob).isNotNull()).groupBy(
        *by, step(value, actual_ts).alias("_a"), step(prob, prob_ts).alias("_p")
    ).agg(F.count("*").alias("n"))
    pairs = [
        F.struct(F.lit(float(x)).alias("actual_threshold"), F.lit(i).alias("i"), F.lit(float(y)).alias("prob_threshold"), F.lit(j).alias("j"))
        for i, x in enumerate(sorted(actual_ts)) for j, y in enumerate(sorted(prob_ts))
    ]
    cells = counts.select(*by, "_a", "_p", "n", F.explode(F.array(*pairs)).alias("g")).select(*by, "_a", "_p", "n", "g.*")
    a, p, n = F.col("_a") > F.col("i"), F.col("_p") > F.col("j"), F.col("n")
    zero = F.lit(0).cast("long")
    total = lambda cond: F.sum(F.when(cond, n).otherwise(zero))
    out = cells.groupBy(*by, "actual_threshold", "prob_threshold").agg(
        total(a & p).alias("tp"), total(~a & p).alias("fp"), total(a & ~p).alias("fn")
    )
    null = F.lit(None).cast("double")
    return out.select(
        *by, "actual_threshold", "prob_threshold",
        F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(null).alias("precision"),
        F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(null).alias("recall"),
    )


def grid_medians(grid: DataFrame, by: Sequence[str] = ("prob_threshold",)) -> DataFrame:
    """Median precision and recall per threshold and their length ``sqrt(P^2 + R^2)`` (the grid is small)."""
    return grid.groupBy(*by).agg(F.median("precision").alias("precision"), F.median("recall").alias("recall")).withColumn(
        "combined", F.sqrt(F.pow("precision", F.lit(2)) + F.pow("recall", F.lit(2)))
    )


# --- values --------------------------------------------------------------------------------------------------------
def regression_metrics(df: DataFrame, y: str, yhat: str, series: Sequence[str] = ()) -> DataFrame:
    """MSE, MAE, RMSE over all rows; ``forecast_rmse``: mean over series of each series' root mean square."""
    err = F.col(yhat) - F.col(y)
    parts = df.groupBy(*series).agg(F.sum(err * err).alias("sq"), F.sum(F.abs(err)).alias("ab"), F.count(err).alias("n"))
    return parts.where("n > 0").agg(
        (F.sum("sq") / F.sum("n")).alias("mse"), (F.sum("ab") / F.sum("n")).alias("mae"),
        F.sqrt(F.sum("sq") / F.sum("n")).alias("rmse"), F.avg(F.sqrt(F.col("sq") / F.col("n"))).alias("forecast_rmse"),
    )


def masked(df: DataFrame, pos: str, length: str) -> DataFrame:
    """Rows inside the valid length of their sequence (positions from 0)."""
    return df.where(F.col(pos) < F.col(length))


def accuracy(df: DataFrame, scores: str, label: str, k: int = 1) -> DataFrame:
    """Share of rows whose label is among the ``k`` highest scores (lower index first on ties)."""
    own = F.get(scores, F.col(label))
    ahead = F.size(F.filter(F.transform(scores, lambda x, i: (x > own) | ((x == own) & (i < F.col(label)))), lambda b: b))
    return df.agg(F.avg((ahead < k).cast("double")).alias(f"accuracy_at_{k}"))


def binary_accuracy(df: DataFrame, logit: str, label: str) -> DataFrame:
    return df.agg(F.avg(((F.col(logit) >= 0) == (F.col(label) == 1)).cast("double")).alias("accuracy"))


def f1(df: DataFrame, actual: str, predicted: str, average: str = "macro") -> DataFrame:
    """F1 of class 1 (``binary``), mean over classes (``macro``) or from pooled counts (``micro``)."""
    counts = _class_counts(df, actual, predicted, [])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    if average == "binary":
        return counts.where("label = 1").select(_share(2 * tp, 2 * tp + fp + fn).alias("f1"))
    if average == "macro":
        return counts.agg(F.avg(_share(2 * tp, 2 * tp + fp + fn)).alias("f1"))
    if average != "micro":
        raise ValueError(f"unknown average {average!r}")
    return counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).select(_share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, prob: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half.

    Rows are counted per distinct score, then running counts are taken in slices of the score.
    """
    pos = (F.col(label) == 1).cast("long")
    per_score = df.where(F.col(prob).isNotNull()).groupBy(F.col(prob).cast("double").alias("score")).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    ranked = running_total(per_score, [], ["score"], magnitude_slices("score"), {"below": F.col("neg")}, inclusive=False)
    wins = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    return ranked.agg(F.sum(wins).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p").cast("double") * F.col("n"))).alias("auc")
    )


def log_loss(df: DataFrame, scores: str, label: str, smoothing: float = 0.0) -> DataFrame:
    """Mean cross-entropy of class scores; with label smoothing the target gives ``smoothing`` to all classes evenly."""
    lse = ar.log_sum_exp(scores)
    own = lse - F.get(scores, F.col(label))
    even = lse - ar.array_sum(scores) / F.size(scores)
    return df.agg(F.avg((1 - smoothing) * own + smoothing * even).alias("loss"))


def binary_log_loss(df: DataFrame, logit: str, target: str) -> DataFrame:
    """Mean cross-entropy of a logit and a probability target, in the overflow-safe form."""
    x, y = F.col(logit), F.col(target)
    return df.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def perplexity(loss: DataFrame) -> DataFrame:
    return loss.select(F.exp("loss").alias("perplexity"))


def bits_per_byte(loss: DataFrame) -> DataFrame:
    return loss.select((F.col("loss") / math.log(2)).alias("bits_per_byte"))


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gaussian_nll(df: DataFrame, mu: str, sigma: str, y: str) -> DataFrame:
    s = _softplus(F.col(sigma))
    nll = F.log(s) + 0.5 * math.log(2 * math.pi) + 0.5 * F.pow((F.col(y) - F.col(mu)) / s, 2)
    return df.agg(F.avg(nll).alias("nll"))


def _lgamma(x: Column) -> Column:
    """Log-gamma of a positive number: Stirling's series, after ten steps up where it is exact to double precision."""
    step = F.lit(1.0)
    for k in range(10):
        step = step * (x + k)
    y = x + 10
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188))))) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(step)


def student_t_nll(df: DataFrame, mu: str, sigma: str, nu: str, y: str) -> DataFrame:
    s, v = _softplus(F.col(sigma)), 2 + _softplus(F.col(nu))
    half = (v + 1) / 2
    z = _lgamma(half) - _lgamma(v / 2) - 0.5 * F.log(math.pi * v) - F.log(s)
    ll = z - half * F.log1p(F.pow((F.col(y) - F.col(mu)) / s, 2) / v)
    return df.select((-ll).alias("nll")).agg(F.avg("nll").alias("nll"))


def iou(df: DataFrame, score: str, truth: str, threshold: float = 0.5, eps: float = 1e-7) -> DataFrame:
    """Overlap of thresholded scores and 0/1 truth."""
    hit = (F.col(score) > threshold).cast("double")
    both = F.sum(F.col(truth) * hit)
    return df.agg(((both + eps) / (F.sum(F.col(truth)) + F.sum(hit) - both + eps)).alias("iou"))


def focal_loss(df: DataFrame, logit: str, truth: str, gamma: float = 2.0, alpha: float | None = 0.25) -> DataFrame:
    x, y = F.col(logit), F.col(truth).cast("double")
    ce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    loss = F.pow(1 - F.exp(-ce), gamma) * ce
    if alpha is not None:
        loss = loss * (alpha * y + (1 - alpha) * (1 - y))
    return df.agg(F.avg(loss).alias("loss"))


# --- raters --------------------------------------------------------------------------------------------------------
def screen_raters(df: DataFrame, controls: DataFrame, worker: str = "worker", on: Sequence[str] = ("method", "item"),
                  score: str = "quality", limit: str = "max_quality") -> DataFrame:
    """Drop raters who rated a control item above its limit, and the control items."""
    blocked = df.join(controls, list(on)).where(F.col(score) > F.col(limit)).select(worker).distinct()
    return df.join(blocked, worker, "left_anti").join(controls.select(*on), list(on), "left_anti")


def cohen_kappa(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Agreement rate and Cohen's kappa per group."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    margins = counts.select(*by, F.explode(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")),
        F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")),
    )).alias("m")).groupBy(*by, "m.label").agg(F.sum("m.na").alias("na"), F.sum("m.nb").alias("nb"))
    expected = margins.groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("_e"))
    seen = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("_same"))
    po = F.col("_same") / F.col("n")
    pe = F.col("_e") / (F.col("n").cast("double") * F.col("n"))
    return seen.join(expected, list(by)).select(*by, "n", po.alias("agreement"), ((po - pe) / (1 - pe)).alias("kappa"))


def unequal_methods(df: DataFrame, method: str, item: str) -> DataFrame:
    """Methods that lack items other methods have."""
    n = df.select(item).distinct().agg(F.count("*"))
    return df.groupBy(method).agg(F.count_distinct(item).alias("items")).where(F.col("items") < n.scalar())


def rating_batches(items: DataFrame, item: str, methods: Sequence[str], size: int, seed: int) -> DataFrame:
    """Batches with the same ``size`` items for every method, a unique id per (method, item), places shuffled inside."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    names = items.select(item).distinct()
    if names.count() % size:
        raise ValueError("the batch size must divide the number of items")
    shuffled = with_ordinal(names.withColumn("_h", seeded_hash([item], seed)), [], ["_h", item], hash_slices("_h"), "_no")
    batched = shuffled.withColumn("batch", F.floor((F.col("_no") - 1) / size).cast("long"))
    rows = batched.select(item, "batch", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    uid = F.md5(F.concat_ws("|", "method", F.col(item).cast("string"), F.lit(str(seed))))
    # a batch holds size * len(methods) rows
    return rows.withColumn("uid", uid).withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("uid")))


# --- sample quality ------------------------------------------------------------------------------------------------
def _halves(df: DataFrame, id_cols: Sequence[str], seed: int) -> DataFrame:
    """Seeded halves: ``half`` is 1 for the first ``n // 2`` rows, else 2."""
    numbered = with_ordinal(df.withColumn("_h", seeded_hash(id_cols, seed)), [], ["_h", *id_cols], hash_slices("_h"), "_no")
    n = df.agg(F.count("*")).scalar()
    return numbered.withColumn("_n", n).withColumn("half", F.when(F.col("_no") <= F.floor(F.col("_n") / 2), 1).otherwise(2)).drop("_h", "_no", "_n")


def _mean_array(df: DataFrame, col: str) -> DataFrame:
    """One row: the mean array, entry by entry."""
    per_entry = df.select(F.posexplode(col).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return per_entry.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def inception_score(df: DataFrame, probs: str, id_cols: Sequence[str], seed: int, axis: str = "sample") -> DataFrame:
    """exp of the mean divergence of one half's class probabilities from the other half's mean.

    ``axis="sample"`` compares each sample with the mean over classes; ``"class"`` compares, per class, the spread over
    samples with an even one.
    """
    halves = _halves(df.select(*id_cols, probs), id_cols, seed)
    first = halves.where("half = 1")
    if axis == "sample":
        mean = _mean_array(halves.where("half = 2"), probs)
        return first.withColumn("_m", mean.scalar()).select(ar.kl(probs, "_m").alias("d")).agg(F.exp(F.avg("d")).alias("score"))
    if axis != "class":
        raise ValueError("axis is 'sample' or 'class'")
    x = first.select(F.posexplode(probs).alias("i", "x"))
    per_class = x.groupBy("i").agg(
        F.sum("x").alias("s"), F.sum(F.when(F.col("x") > 0, F.col("x") * F.log("x")).otherwise(0.0)).alias("xlx"), F.count("*").alias("n")
    )
    d = F.col("xlx") / F.col("s") - F.log("s") + F.log("n")
    return per_class.agg(F.exp(F.avg(d)).alias("score"))


def modified_inception_score(df: DataFrame, probs: str, id_cols: Sequence[str], n: int, seed: int) -> DataFrame:
    """exp of the mean divergence over ``n`` seeded pairs drawn with replacement: two equi-joins on row numbers."""
    numbered = with_ordinal(
        df.select(*id_cols, probs).withColumn("_h", seeded_hash(id_cols, seed)), [], ["_h", *id_cols], hash_slices("_h"), "_no"
    ).select("_no", probs)
    size = df.agg(F.count("*")).scalar()
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(f"{seed}-{salt}"))), 1, 12), 16, 10).cast("long") % F.col("_size") + 1
    draws = df.sparkSession.range(n).withColumn("_size", size).select(draw("a").alias("_a"), draw("b").alias("_b"))
    a = numbered.select(F.col("_no").alias("_a"), F.col(probs).alias("_p"))
    b = numbered.select(F.col("_no").alias("_b"), F.col(probs).alias("_q"))
    pairs = draws.join(a, "_a").join(b, "_b")
    return pairs.select(ar.kl("_p", "_q").alias("d")).agg(F.exp(F.avg("d")).alias("score"))


def am_score(data: DataFrame, gen: DataFrame, probs: str) -> DataFrame:
    """Divergence of the mean class shares plus the mean entropy of the generated ones."""
    ent = gen.agg(F.avg(ar.entropy(probs)).alias("entropy"))
    return ent.select(
        "entropy", _mean_array(data, probs).scalar().alias("_d"), _mean_array(gen, probs).scalar().alias("_g")
    ).select((ar.kl("_d", "_g") + F.col("entropy")).alias("score"))


def _covariance(df: DataFrame, col: str, side: str) -> DataFrame:
    """Mean and covariance as (side, i, j, value) rows; j = -1 holds the mean. Partitions send d x d sums, no rows."""
    mean = _mean_array(df, col)
    centred = df.select(F.col(col).cast("array<double>").alias("x")).withColumn("m", mean.scalar())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()) - np.asarray(pdf["m"].iloc[0])
                total = x.T @ x if total is None else total + x.T @ x
                n += len(x)
        if total is not None:
            d = total.shape[0]
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "s": total.ravel(), "n": n})

    parts = centred.mapInPandas(sums, "i int, j int, s double, n long")
    cov = parts.groupBy("i", "j").agg((F.sum("s") / (F.sum("n") - 1)).alias("value"))
    means = mean.select(F.posexplode("mean").alias("i", "value")).select("i", F.lit(-1).alias("j"), "value")
    return cov.unionByName(means).withColumn("side", F.lit(side))


def frechet_distance(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Fréchet distance of two feature sets: distributed means and covariances, then one d x d matrix root."""

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        def moments(side):
            p = pdf[pdf["side"] == side]
            mu = p[p["j"] < 0].sort_values("i")["value"].to_numpy()
            cov = np.zeros((len(mu), len(mu)))
            c = p[p["j"] >= 0]
            cov[c["i"], c["j"]] = c["value"]
            return mu, cov

        (m1, c1), (m2, c2) = moments("a"), moments("b")

        def root_trace(x, y):
            w, v = np.linalg.eigh(x)
            half = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
            return np.sqrt(np.clip(np.linalg.eigvalsh(half @ y @ half), 0, None)).sum()

        return pd.DataFrame({"distance": [float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * root_trace(c1, c2))]})

    return feature_moments(a, b, col).groupBy().applyInPandas(distance, "distance double")


def feature_moments(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Means (j = -1) and covariances of two feature sets as (side, i, j, value): 2 d (d + 1) numbers, however many rows."""
    return _covariance(a, col, "a").unionByName(_covariance(b, col, "b"))


def two_proportions(p1: Column, n1: Column, p2: Column, n2: Column, z_limit: float = 1.96) -> Column:
    """True where two proportions differ (two-sided z test)."""
    p = (p1 * n1 + p2 * n2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return F.coalesce(F.abs(p1 - p2) > z_limit * se, F.lit(False)) & (se > 0)


def ndb(a: DataFrame, b: DataFrame, col: str, k: int = 50, seed: int = 0) -> DataFrame:
    """Share of k-means cells (fitted on ``a``) that hold different proportions of ``a`` and ``b``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = lambda d: d.select(array_to_vector(F.col(col).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(vectors(a))
    placed = lambda d: model.transform(vectors(d)).select(F.col("prediction").alias("cell"))
    return ndb_of_cells(placed(a), placed(b), k)


def ndb_of_cells(a: DataFrame, b: DataFrame, k: int, cell: str = "cell") -> DataFrame:
    """Share of the ``k`` cells whose proportions of ``a`` and ``b`` differ, for rows already placed in cells."""
    cells = lambda d, name: d.groupBy(cell).agg(F.count("*").alias(name))
    na, nb = a.agg(F.count("*")).scalar(), b.agg(F.count("*")).scalar()
    both = cells(a, "ca").join(cells(b, "cb"), cell, "left").withColumns({"cb": F.coalesce("cb", F.lit(0)), "na": na, "nb": nb})
    differs = two_proportions(F.col("ca") / F.col("na"), F.col("na"), F.col("cb") / F.col("nb"), F.col("nb"))
    return both.agg((F.sum(differs.cast("int")) / float(k)).alias("ndb"))


def tune_thresholds(df: DataFrame, order: Sequence[str], probs: str, slices, id_cols: Sequence[str], seed: int = 0,
                    lows: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.4),
                    highs: Sequence[float] = (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)) -> DataFrame:
    """Inception score of every kept range (the default grid is of fixed values) [low * n, high * n) of rows in ``order``, with the best one marked.

    Rows are summed once per segment between neighbouring cuts and seeded half; a candidate range is a sum of segments.
    The score splits as sum(p log p) - sum(p) . log(mean of the other half), so sums are all it needs.
    """
    cuts = sorted({*lows, *highs})
    n = F.col("_n")
    at = lambda r: F.floor(n * F.lit(float(r)) + 1e-9)
    numbered = with_ordinal(df.select(*id_cols, *[c for c in order if c not in id_cols], probs), [], list(order), slices, "_no").withColumn("_n", df.agg(F.count("*")).scalar())
    segment = sum((F.col("_no") - 1 >= at(c)).cast("int") for c in cuts)
    half = F.conv(F.substring(seeded_hash(id_cols, seed), 1, 1), 16, 10).cast("int") % 2
    p = ar.normalized(probs)
    long = numbered.select(segment.alias("seg"), half.alias("half"), F.posexplode(p).alias("i", "x"))
    sums = long.groupBy("seg", "half", "i").agg(
        F.sum("x").alias("s"), F.sum(F.when(F.col("x") > 0, F.col("x") * F.log("x")).otherwise(0.0)).alias("e"), F.count("*").alias("c")
    )
    # segment q holds rows from cut q - 1 up to cut q
    ranges = [F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(cuts.index(a) + 1).alias("from"), F.lit(cuts.index(b)).alias("to")) for a in lows for b in highs]
    cand = sums.select("*", F.explode(F.array(*ranges)).alias("r")).where(F.col("seg").between(F.col("r.from"), F.col("r.to")))
    pick = lambda h, c: F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0))
    per_class = cand.groupBy("r.low", "r.high", "i").agg(
        pick(0, "s").alias("s1"), pick(0, "e").alias("e1"), pick(0, "c").alias("n1"), pick(1, "s").alias("s2"), pick(1, "c").alias("n2")
    )
    term = F.col("e1") - F.col("s1") * F.log(F.col("s2") / F.col("n2"))
    scored = per_class.groupBy("low", "high").agg(F.exp(F.sum(term) / F.max("n1")).alias("score"))
    best = scored.agg(F.max_by(F.struct("low", "high"), F.struct("score", -F.col("low"), -F.col("high"))))
    return scored.withColumn("is_best", F.struct("low", "high") == best.scalar())

"""Measures and models without an SQL form, against direct computation on small data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import evaluate as ev
from skyloom.operators import models as md
from skyloom.operators import reshape as rh


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def test_frechet_distance(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (200, 4)), rng.normal(0.5, 2, (150, 4)) @ rng.normal(0, 1, (4, 4))
    got = ev.frechet_distance(vectors(spark, a).repartition(5), vectors(spark, b).repartition(3), "x").head()[0]
    c1, c2 = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    root = np.sqrt(np.abs(np.linalg.eigvals(c1 @ c2))).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * root
    assert got == pytest.approx(want)
    same = ev.frechet_distance(vectors(spark, a), vectors(spark, a), "x").head()[0]
    assert same == pytest.approx(0, abs=1e-8)


def test_ndb_of_equal_and_of_shifted_sets(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, (300, 3))
    df = vectors(spark, a)
    assert ev.ndb(df, df, "x", k=5).head()[0] == 0
    assert ev.ndb(df, vectors(spark, a + [4, 0, 0]), "x", k=5).head()[0] > 0.5


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(2)
    p, y = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    got = ev.roc_auc(spark.createDataFrame(pd.DataFrame({"p": p, "y": y})), "p", "y").head()[0]
    diff = p[y == 1][:, None] - p[y == 0][None, :]
    assert got == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())


def test_woe_bins_separate_and_cover(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.normal(0, 1, n)
    y = (x + rng.normal(0, 0.5, n) > 0.3).astype(int)
    pdf = pd.DataFrame({"x": np.where(rng.random(n) < 0.1, np.nan, x), "noise": rng.random(n), "y": y})
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    bins = md.woe_fit(df, "y", ["x", "noise"]).toPandas()
    assert bins.groupby("var")["n"].sum().tolist() == [n, n]
    assert (bins["n"] >= 0.05 * n).all()
    own = bins[(bins["var"] == "x") & ~bins["is_missing"]].sort_values("bin")
    assert own["woe"].is_monotonic_increasing and own["iv"].iloc[0] > 0.4
    assert bins[bins["var"] == "noise"]["iv"].iloc[0] < 0.1
    fitted = spark.createDataFrame(bins)
    assert [r["var"] for r in md.woe_select(fitted, 0.4).collect()] == ["x"]
    coded = md.woe_apply(df, fitted, ["x", "noise"]).toPandas()
    assert coded[["x_woe", "noise_woe"]].notna().all().all()
    counts = coded.groupby("x_woe").size().sort_index().tolist()
    assert sorted(counts) == sorted(bins[bins["var"] == "x"]["n"].tolist())


def plain_bins(x, y, min_total, min_class, stop_limit):
    """The rule of the bins, one variable at a time: [(hi, n, pos)], the missing values last."""
    known = ~np.isnan(x)
    edges = np.unique(np.quantile(x[known], [i / round(1 / min_total) for i in range(1, round(1 / min_total))]))
    place = np.searchsorted(edges, x[known], side="left")
    rows = [[edges[b] if b < len(edges) else np.nan, (place == b).sum(), y[known][place == b].sum()] for b in np.unique(place)]
    n, pos = len(y), y.sum()

    def woe(r):
        return np.log((max(r[2], 0.5) / pos) / (max(r[1] - r[2], 0.5) / (n - pos)))

    def iv(r):
        return (max(r[2], 0.5) / pos - max(r[1] - r[2], 0.5) / (n - pos)) * woe(r)

    def merged(rs, i):
        return rs[:i] + [[rs[i + 1][0], rs[i][1] + rs[i + 1][1], rs[i][2] + rs[i + 1][2]]] + rs[i + 2:]

    while len(rows) > 1:
        bad = [i for i, r in enumerate(rows) if r[1] < min_total * n or r[2] < min_class * pos or r[1] - r[2] < min_class * (n - pos)]
        if bad:
            sides = [i for i in (bad[0] - 1, bad[0]) if 0 <= i < len(rows) - 1]
            rows = merged(rows, min(sides, key=lambda i: round(abs(woe(rows[i]) - woe(rows[i + 1])), 12)))
            continue
        before = sum(map(iv, rows))
        best = max((merged(rows, i) for i in range(len(rows) - 1)), key=lambda rs: round(sum(map(iv, rs)), 12))
        if len(rows) <= 2 or before - sum(map(iv, best)) > stop_limit * before:
            break
        rows = best
    rows[-1][0] = np.nan
    return rows + ([[np.nan, (~known).sum(), y[~known].sum()]] if (~known).any() else [])


@pytest.mark.parametrize("limits", [(0.05, 0.001, 0.1), (0.1, 0.05, 0.02), (0.02, 0.2, 0.3)])
def test_woe_bins_against_the_plain_rule(spark, limits):
    rng = np.random.default_rng(7)
    n = 2000
    cols = {"even": rng.random(n), "whole": rng.integers(0, 6, n) * 1.0, "skewed": rng.exponential(1, n) ** 3, "hot": np.where(rng.random(n) < 0.7, 1.0, rng.random(n))}
    y = (cols["skewed"] + cols["whole"] * rng.random(n) > 3).astype(int)
    cols["whole"][rng.random(n) < 0.08] = np.nan
    df = spark.createDataFrame(pd.DataFrame({**cols, "y": y})).repartition(5)
    got = md.woe_fit(df, "y", list(cols), *limits).toPandas().sort_values(["var", "bin"])
    for c, x in cols.items():
        own, want = got[got["var"] == c], plain_bins(x, y, *limits)
        assert own[["n", "pos"]].to_numpy().tolist() == [[r[1], r[2]] for r in want]
        assert np.allclose(own["hi"].astype(float), [r[0] for r in want], equal_nan=True)
        assert own["is_missing"].tolist() == [False] * (len(want) - np.isnan(x).any()) + [True] * int(np.isnan(x).any())


def test_woe_of_columns_without_values(spark):
    df = spark.createDataFrame([(None, 1.0, i % 2) for i in range(10)], "gone double, same double, y int")
    bins = {r["var"]: r for r in md.woe_fit(df, "y", ["gone", "same"]).collect()}
    assert (bins["gone"]["is_missing"], bins["gone"]["n"], bins["gone"]["pos"]) == (True, 10, 5)
    assert (bins["same"]["is_missing"], bins["same"]["hi"], bins["same"]["n"]) == (False, None, 10)
    assert md.woe_fit(df.where("y > 5"), "y", ["gone", "same"]).count() == 0


def test_logistic_on_woe(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 800)
    df = spark.createDataFrame(pd.DataFrame({"id": range(800), "x": x, "y": (x > 0).astype(int)}))
    model = md.fit_logistic(df, "y", ["x"], "multinomial")
    out = md.predict_logistic(df, model, ["id", "y"]).toPandas()
    assert (out["Predicted"] == out["y"]).mean() > 0.97
    assert np.allclose(out["probs"].map(sum), 1)


def test_scoring_keeps_rows_and_orders_classes(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "id long, x double").repartition(4)
    out = md.score(df, lambda v: v[:, :1] - 25, ["x"]).toPandas()
    assert len(out) == 50 and ((out["x"] > 25) == (out["Predicted"] == 1)).all()


def test_ar1_of_an_exact_recursion(spark):
    y = [1.0]
    for _ in range(29):
        y.append(0.8 * y[-1] + 2)
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(y)], "k string, i long, y double")
    from skyloom.slicing import magnitude_slices

    out = md.ar1_forecast(df, ["k"], ["i"], "y", magnitude_slices("i")).toPandas()
    assert len(out) == 6 and np.allclose(out["actual"], out["forecast"])


def test_balanced_sample_evens_out_a_hot_class(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").otherwise("c").alias("cls"))
    shares = rh.balanced_sample(df, "cls", 6000, 1, ["id"]).groupBy("cls").count().collect()
    assert sum(r["count"] for r in shares) == 6000
    assert all(1700 < r["count"] < 2300 for r in shares)


def test_tuned_threshold_is_the_best_one(spark):
    from skyloom.slicing import magnitude_slices

    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(4) * 0.3, 400)
    df = vectors(spark, p).withColumn("like", F.col("id").cast("double"))
    out = ev.tune_thresholds(df, ["like", "id"], "x", magnitude_slices("like"), ["id"]).toPandas()
    assert len(out) == 40 and out["is_best"].sum() == 1
    assert out.loc[out["is_best"], "score"].iloc[0] == out["score"].max()


def test_worker_functions_need_no_package(tmp_path):
    """What Spark sends to Python workers can be loaded where this package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    blob = tmp_path / "f.pkl"
    blob.write_bytes(cloudpickle.dumps(md.score))
    code = f"import pickle; print(pickle.load(open({str(blob)!r}, 'rb')).__name__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("score"), out.stderr

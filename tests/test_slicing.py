"""The sliced forms against brute force, on a key that holds most rows and on slices far smaller than the key."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyloom.operators import features as fe
from skyloom.operators import sequences as sq
from skyloom.operators import text as tx
from skyloom.operators.quantiles import exact_quantiles
from skyloom.slicing import carry, magnitude_slices, own_rows, row_frames, running_total, time_slices, with_ordinal


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c", None], n)),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 6 * 3600, n), unit="s"),
        "id": np.arange(n), "v": np.round(rng.normal(0, 50, n), 2),
    })
    pdf.loc[rng.random(n) < 0.3, "v"] = np.nan
    pdf["v"] = pdf["v"].where(pdf["v"].notna(), None)
    df = spark.createDataFrame(pdf, "k string, ts timestamp, id long, v double").withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return df, pdf.sort_values(["ts", "id"]).assign(v=lambda d: pd.to_numeric(d["v"]))


def by_id(df, col):
    return df.select("id", col).toPandas().set_index("id")[col].sort_index()


def test_ordinal_matches_cumcount(readings):
    df, pdf = readings
    got = by_id(with_ordinal(df, ["k"], ["ts", "id"], time_slices("ts", "hour", "minute")), "pos")
    want = pd.Series(pdf.groupby("k", dropna=False).cumcount().to_numpy() + 1, index=pdf["id"]).sort_index()
    assert (got == want).all()


def test_global_ordinal(readings):
    df, pdf = readings
    got = by_id(with_ordinal(df, [], ["ts", "id"], time_slices("ts", "minute")), "pos")
    assert (got == pd.Series(np.arange(1, len(pdf) + 1), index=pdf["id"]).sort_index()).all()


def test_running_total_matches_cumsum(readings):
    df, pdf = readings
    got = by_id(running_total(df, ["k"], ["ts", "id"], time_slices("ts", "minute"), {"t": F.coalesce("v", F.lit(0.0))}, inclusive=False), "t")
    filled = pdf["v"].fillna(0)
    want = filled.groupby(pdf["k"], dropna=False).cumsum() - filled
    want.index = pdf["id"]
    assert np.allclose(got, want.sort_index())


def test_magnitude_slices_keep_the_order_of_numbers(spark):
    xs = sorted([0.0, -0.0, 1e-300, -1e-300, 1.0, 1.0000001, -5.5, 3e8, -2e9, 123.456, 123.457, 1e308, -1e308])
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", *[c.alias(f"s{i}") for i, c in enumerate(magnitude_slices("x"))]).orderBy("x").collect()
    keys = [(r.s0, r.s1) for r in rows]
    assert keys == sorted(keys)


def test_carry_matches_fill(readings):
    df, pdf = readings
    one = df.withColumn("at", F.unix_seconds("ts") * 10000 + F.col("id"))
    out = carry(one, ["k"], "at", F.floor(F.col("at") / (600 * 10000)), ["v"], ahead=True)
    back = by_id(out.withColumn("b", F.col("_prev_v.value")), "b")
    ahead = by_id(out.withColumn("a", F.col("_next_v.value")), "a")
    g = pdf.groupby("k", dropna=False)["v"]
    for got, want in ((back, g.ffill()), (ahead, g.bfill())):
        want.index = pdf["id"]
        want = want.sort_index()
        assert (got.isna() == want.isna()).all() and np.allclose(got.dropna(), want.dropna())


@pytest.mark.parametrize("length", [1, 7, 100000])
def test_row_frames_see_neighbours_across_slices(readings, length):
    df, pdf = readings
    frame, w = row_frames(df, ["k"], ["ts", "id"], time_slices("ts", "minute"), before=3, after=2, length=length)
    out = own_rows(frame.withColumn("s", F.sum("id").over(w.rowsBetween(-3, 2))))
    want = {}
    for _, g in pdf.groupby("k", dropna=False):
        ids = g["id"].to_numpy()
        for i in range(len(ids)):
            want[ids[i]] = ids[max(0, i - 3): i + 3].sum()
    assert out.count() == len(pdf)
    assert (by_id(out, "s") == pd.Series(want).sort_index()).all()


def test_exact_quantiles_of_a_hot_group(readings):
    df, pdf = readings
    got = {(r.k, r.prob): r.value for r in exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for k, g in pdf.dropna(subset=["v"]).groupby("k"):
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[(k, p)] == pytest.approx(np.quantile(g["v"], p))


def test_interpolation_over_a_gap_longer_than_a_slice(spark):
    days = pd.date_range("2020-01-01", "2020-12-31", freq="D")
    v = pd.Series(np.nan, index=days)
    v.iloc[[2, 200, 360]] = [10.0, 50.0, 20.0]
    pdf = pd.DataFrame({"stationid": "s", "datetime": days, "v": v.to_numpy()})
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = fe.interpolate_time(df, "stationid", "datetime", ["v"]).orderBy("datetime").toPandas()["v"]
    assert np.allclose(got, v.interpolate("time").ffill().bfill())


def test_all_missing_series_stays_missing(spark):
    df = spark.createDataFrame([("s", f"2020-01-0{d}", None) for d in range(1, 5)], "stationid string, datetime string, v double").withColumn("datetime", F.col("datetime").cast("timestamp"))
    assert fe.interpolate_time(df, "stationid", "datetime", ["v"]).where("v is not null").count() == 0


def test_chunks_and_tail(spark):
    df = spark.range(23).select(F.lit("k").alias("k"), "id", (F.col("id") * 2).alias("v"))
    full = sq.chunk(df, ["k"], ["id"], "v", 5, magnitude_slices("id")).orderBy("chunk").collect()
    assert [r["values"] for r in full] == [[2 * (5 * c + i) for i in range(5)] for c in range(4)]
    assert sq.chunk(df, ["k"], ["id"], "v", 5, magnitude_slices("id"), drop_last=False).count() == 5


def test_overlap_chunks_follow_the_stepping_rule(spark):
    values, step, overlap = list(range(100, 123)), 4, 3
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i long, v long")
    out = sq.overlap_chunks(df, ["k"], ["i"], "v", step, overlap, magnitude_slices("i"), zero=-1).orderBy("chunk").collect()
    padded = [-1] * (overlap - 1) + values
    begins = list(range(overlap - 1, len(padded), step))[:-1]
    assert [r["values"] for r in out] == [padded[b - overlap + 1: b + step] for b in begins]
    assert [r.reset for r in out] == [True] + [False] * (len(begins) - 1)


@pytest.mark.parametrize("batch,l_max,n_context", [(1, 6, 1), (3, 8, 2), (4, 9, 3), (7, 4, 4)])
def test_token_stream_matches_slicing_by_hand(spark, batch, l_max, n_context):
    rng = np.random.default_rng(batch)
    docs = [(int(i), [int(x) for x in rng.integers(0, 99, rng.integers(0, 40))]) for i in rng.permutation(30)]
    df = spark.createDataFrame(docs, "id long, ids array<int>")
    got = {(r.row, r.step): (r.input_ids, r.target_ids) for r in tx.token_stream(df, "id", "ids", batch, l_max, n_context).collect()}
    flat = [x for _, ids in sorted(docs) for x in ids]
    w, inc = len(flat) // batch, l_max // n_context
    want = {}
    for r in range(batch):
        row = flat[r * w: (r + 1) * w]
        for s, i in enumerate(range(0, w - 1, inc)):
            end = min(i + inc, w - 1)
            want[(r, s)] = (row[max(0, i + inc - l_max): end], row[i + 1: end + 1])
    assert got == want


def test_packed_rows_are_full_and_keep_every_pair(spark):
    rng = np.random.default_rng(1)
    docs = [(i, [int(x) for x in rng.integers(0, 99, rng.integers(1, 30))]) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, ids array<int>")
    rows = tx.pack_sentences(df, "id", "ids", 16, 2, 5).collect()
    assert rows and all(len(r.input_ids) == len(r.target_ids) == 16 for r in rows)
    pairs = {(a, b) for _, ids in docs for a, b in zip(ids, ids[1:])}
    assert all((a, b) in pairs for r in rows for a, b in zip(r.input_ids, r.target_ids))
    total = sum(len(ids) - 1 for _, ids in docs)
    assert total - 16 * len(rows) < 2 * 16

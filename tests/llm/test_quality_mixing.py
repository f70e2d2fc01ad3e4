from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import mixing, quality
from skyloom.llm.queries import LANGUAGE_WEIGHTS, op4_mixing, op6_quality_classifier

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").cache()


# --- quality


def test_held_out_quality(docs, labels):
    shown = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    got = quality.quality_scores(docs, shown).join(labels, "doc_id").join(shown.select("doc_id"), "doc_id", "left_anti").collect()
    assert len(got) > 100 and np.mean([r.keep == (r.quality == 1) for r in got]) > 0.95


def test_rates_by_hand(spark):
    rows = [(i, "s1", "a" if i % 2 else "b", 1 if i % 5 else 0) for i in range(40)] + [(100 + i, None, None, 0) for i in range(20)] + [(200, "s3", "a", 1)]
    docs = spark.createDataFrame([(i, s, p) for i, s, p, _ in rows], "doc_id long, source string, lang string")
    known = quality.labels_by_id(spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, quality int"), "doc_id", "quality")
    got = quality.rates(docs, known, "doc_id", F.col("source"), F.col("lang"))

    def strength(groups):
        n, good, rate = (np.array(x, float) for x in zip(*groups))
        spread, chance, inside = (n * (good / n - rate) ** 2).sum(), (rate * (1 - rate)).sum(), (n * rate * (1 - rate)).sum() / n.sum()
        between = (spread - chance) / (n.sum() - (n**2).sum() / n.sum())
        return min(max(inside / between - 1, 1), 1e6) if between > 0 else 1e6

    rate = (sum(r[3] for r in rows) + 1) / (len(rows) + 2)
    assert got.rate == pytest.approx(rate)
    sites = {s: (sum(1 for r in rows if r[1] == s), sum(r[3] for r in rows if r[1] == s)) for s in ("s1", None, "s3")}
    a = strength([(n, g, rate) for n, g in sites.values()])
    want = {s: (g + a * rate) / (n + a) for s, (n, g) in sites.items()}
    assert {r.site: r.site_rate for r in got.sites.collect()} == pytest.approx(want)
    paths = {k: (sum(1 for r in rows if r[1:3] == k), sum(r[3] for r in rows if r[1:3] == k)) for k in {r[1:3] for r in rows}}
    b = strength([(n, g, want[s]) for (s, _), (n, g) in paths.items()])
    assert {(r.site, r.path): r.path_rate for r in got.paths.collect()} == pytest.approx({k: (g + b * want[k[0]]) / (n + b) for k, (n, g) in paths.items()})


def test_quality_corners(spark):
    rows = [(1, None, None, None, 5), (1, None, None, None, 5), (2, "", "s", None, 6), (None, "x y z", None, "en", 7), (3, "word " * 100_000, "s", "en", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, evidence int")
    none = spark.createDataFrame([(9, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(df, none).collect()
    assert len(got) == 5 and all(r.keep and r.probability == pytest.approx(0.5) for r in got)
    both = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    got = quality.quality_scores(df, both).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    assert quality.accepted(df, none).columns == df.columns and quality.accepted(df, none).count() == 5
    assert quality.quality_scores(df.limit(0), none).count() == 0


def test_quality_query(spark):
    rows = op6_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        odds = r.evidence + np.log(r.path_rate / (1 - r.path_rate))
        assert r.probability == pytest.approx(1 / (1 + np.exp(-odds))) and r.keep == (r.probability >= 0.5)


# --- mixing


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 500)
    table = spark.createDataFrame([(int(t), list(map(float, q))) for t, q in zip(rng.integers(1, 900, 500), p)], "tokens long, posterior array<double>")
    fit = mixing.fit_rates(table, {"a": 0.5, "b": 0.3, "c": 0.2})
    tokens = np.array([r.tokens for r in table.collect()], float)
    post = np.array([r.posterior for r in table.collect()])
    rates = fit.rates(post)
    totals = (rates * tokens) @ post
    assert (rates >= 0).all() and (rates <= 1).all()
    assert np.allclose(totals, fit.totals, rtol=1e-9)
    # plain projected gradient, run long
    has, wanted, r = tokens @ post, np.array(fit.targets), np.ones(500)
    for _ in range(3000):
        r = np.clip(r - post @ (((r * tokens) @ post - wanted) / has), 0, 1)
    best = (((r * tokens) @ post - wanted) ** 2 / has).sum()
    assert ((totals - wanted) ** 2 / has).sum() <= best + 1e-4 * wanted.sum()
    more = mixing.fit_rates(table, {"a": 0.5, "b": 0.3, "c": 0.2}, most_rate=5.0, total=2.0 * tokens.sum())
    assert np.allclose(more.totals, np.array([0.5, 0.3, 0.2]) * 2 * tokens.sum(), rtol=1e-3)


def test_held_out_domains(docs, labels):
    ids = labels.select(F.col("doc_id").alias("id")).where("id % 2 = 0")
    model = mixing.train(docs, ids, list(LANGUAGE_WEIGHTS), "doc_id", "text", "lang")
    got = docs.where("doc_id % 2 = 1").select("lang", mixing.memberships(F.col("text"), model).alias("p")).collect()
    assert np.mean([model.names[int(np.argmax(r.p))] == r.lang for r in got]) > 0.97
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in got)


def test_mixed_shares(spark, docs, labels):
    weights = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    left = mixing.mixed(docs, labels, weights)
    assert left.columns == docs.columns
    sums = {r.lang: r.n for r in left.groupBy("lang").agg(F.sum(mixing.token_size(F.col("text"))).alias("n")).collect()}
    assert all(abs(sums[k] / sum(sums.values()) - w) < 0.05 for k, w in weights.items())
    twice = mixing.mixed(docs, labels, weights, most_rate=3.0)
    assert twice.groupBy("doc_id").count().agg(F.max("count")).first()[0] > 1


def test_mixing_corners(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (2, "", "en", 6), (None, "der die das", "de", 7), (3, "the " * 100_000, "en", 8), (4, "xx", "zz", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, quality int")
    got = mixing.mixing_rates(df, labels, LANGUAGE_WEIGHTS).collect()
    assert sorted(r.tokens for r in got) == [0, 0, 0, 1, 3, 100_000] and all(0 <= r.rate <= 1 and r.copies in (0, 1) for r in got)
    assert len(mixing.mixing_rates(df, labels.limit(0), LANGUAGE_WEIGHTS).collect()) == 6
    assert mixing.mixing_rates(df.limit(0), labels, LANGUAGE_WEIGHTS).count() == 0 == mixing.mixed(df.limit(0), labels, LANGUAGE_WEIGHTS).count()


def test_mixing_query(spark):
    rows = op4_mixing(spark, SF).collect()
    tokens = {r.doc_id: len([w for w in __import__("re").split("[ \t\n\r\x0b\x0c]+", r.text or "") if w]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.tokens for r in rows} == tokens
    totals = np.array([np.array(r.posterior) * r.tokens * r.rate for r in rows]).sum(axis=0)
    assert np.allclose(totals / totals.sum(), list(LANGUAGE_WEIGHTS.values()), atol=0.01)


def test_mixing_without_a_language(spark, docs, labels):
    left = docs.where("lang <> 'es'")
    rates = mixing.mixing_rates(left, labels, LANGUAGE_WEIGHTS).cache()
    whole = rates.agg(F.sum("tokens")).first()[0]
    assert rates.agg(F.sum(F.col("tokens") * F.col("rate"))).first()[0] > 0.5 * whole
    sums = {r.lang: r.n for r in left.join(rates, "doc_id").groupBy("lang").agg(F.sum(F.col("tokens") * F.col("rate")).alias("n")).collect()}
    present = {k: w / (1 - LANGUAGE_WEIGHTS["es"]) for k, w in LANGUAGE_WEIGHTS.items() if k != "es"}
    assert all(abs(sums[k] / sum(sums.values()) - w) < 0.05 for k, w in present.items())


def test_mixing_with_a_scarce_language(spark):
    sharp = [0.999997, 0.000001, 0.000001, 0.000001]
    rows = [(100, sharp[-k:] + sharp[:-k]) for k in range(3) for _ in range(50)] + [(1, [0.1, 0.2, 0.3, 0.4])]
    table = spark.createDataFrame(rows, "tokens long, posterior array<double>")
    fit = mixing.fit_rates(table, LANGUAGE_WEIGHTS, least_share=0.5)
    assert sum(fit.totals) > 0.4 * 15_001 and not fit.met and fit.shortfall[3] > 0.9 * fit.targets[3]
    assert fit.rates(np.array([[0.1, 0.2, 0.3, 0.4]]))[0] > 0.9


def test_scarce_domain_meets_its_target_or_says_what_it_lacks(spark):
    sharp = [0.97, 0.01, 0.01, 0.01]
    rows = [(100, sharp[-k:] + sharp[:-k]) for k, n in enumerate((200, 200, 200, 20)) for _ in range(n)]
    table = spark.createDataFrame(rows, "tokens long, posterior array<double>")
    fit = mixing.fit_rates(table, {"a": 0.3, "b": 0.3, "c": 0.3, "d": 0.1})
    assert not fit.met and 0 < fit.shortfall[3] < 0.2 * fit.targets[3]  # the total counts what others have of it
    less = mixing.fit_rates(table, {"a": 0.3, "b": 0.3, "c": 0.3, "d": 0.1}, total=15_000)
    assert less.met and np.allclose(np.array(less.totals) / sum(less.totals), [0.3, 0.3, 0.3, 0.1], atol=1e-3)
    forced = mixing.fit_rates(table, {"a": 0.3, "b": 0.3, "c": 0.3, "d": 0.1}, least_share=0.9)
    assert not forced.met and forced.shortfall[3] > 0


def test_one_document_more_changes_no_domain_into_absent(spark):
    few = [(100, [0.9, 0.1])] * 50
    fit = mixing.fit_rates(spark.createDataFrame(few + [(100, [0.6, 0.4])], "tokens long, posterior array<double>"), {"a": 0.8, "b": 0.2})
    assert min(fit.targets) > 0  # nowhere the most probable one, but a domain all the same


def test_report(spark, docs, labels):
    rows = {r.domain: r for r in mixing.mixing_report(docs, labels, LANGUAGE_WEIGHTS).collect()}
    assert set(rows) == set(LANGUAGE_WEIGHTS) and all(r.met and abs(r.shortfall - (r.target - r.total)) < 1e-6 for r in rows.values())


def test_texts_kept_are_scored_once(docs, labels):
    plan = quality.accepted(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1

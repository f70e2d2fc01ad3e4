from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import ann, preference

# --- nearest neighbours


def plain_search(rows, k=5):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[i] = np.array(v, float)
    cos = lambda a, b: (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    out = {}
    for q in (i for i in fine if i % 50 == 0):
        near = sorted(((-cos(fine[q], v), i) for i, v in fine.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 8))
    rows = [(i, list(map(float, base[i % 40 if i > 80 else i]))) for i in range(120)]  # copies: ties
    rows += [(200, None), (250, [0.0] * 8), (300, [1.0] * 7 + [float("nan")]), (350, [1.0] * 7 + [None]), (400, [float("inf")] * 8), (None, [1.0] * 8), (7, rows[7][1]), (450, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, part int")
    seen = {r.vec_id: [float(x) if x is not None else None for x in r.embedding] if r.embedding is not None else None for r in df.collect() if r.vec_id is not None}
    want = plain_search([(i, v if v else None) for i, v in seen.items()])
    got = {}
    for r in ann.search(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-14) for q in want)
    few = ann.search(df.where("vec_id < 3"), lambda i: i % 50 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.search(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_recall_with_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    visits = []
    monkeypatch.setattr(ann, "fit", lambda *a, f=ann.fit: visits.append(f(*a)) or visits[-1])
    got = {}
    for r in ann.search(df, lambda i: i % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_search(list(enumerate(x)))
    assert len(visits[0].bias) == 4 and 1 <= visits[0].probes <= 4
    assert np.mean([len(got[q] & {i for i, _ in v}) / 5 for q, v in want.items()]) >= 0.9


def test_recall_of_the_query(spark):
    from skyloom.llm.queries import op7_nearest_neighbours as query

    sf = "/root/testdata/sf0.1"
    want = plain_search([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    got = {}
    for r in query(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and np.mean([len(got[q] & {i for i, _ in v}) / 5 for q, v in want.items()]) >= 0.9


def test_parts_stay_even():
    rng = np.random.default_rng(3)
    x = ann.unit(rng.normal(size=(2000, 8)) + 2 * rng.normal(size=(1, 8)))
    graph = ann.nearest(x, 10, np.arange(2000))
    start = ann.halved(x, 8)
    part = ann.refined(start, graph, 8)
    inside = lambda p: (p[graph] == p[:, None]).mean()
    assert np.bincount(start).tolist() == [250] * 8 and np.bincount(part).max() <= 275 and inside(part) > inside(start)


# --- preference pairs


def test_prefix_and_masks(spark):
    chosen = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Yes"), (1, 2, "user", "Why"), (1, 3, "assistant", "Because"), (2, 0, "user", "a"), (3, 0, "user", "same"), (4, 0, "user", "only"), (None, 0, "user", "x"), (5, None, None, None), (5, 1, "assistant", "q")]
    rejected = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Yes"), (1, 2, "user", "Why"), (1, 3, "assistant", "No"), (1, 3, "assistant", "No"), (1, 4, "user", "ok"), (2, 0, "system", "a"), (3, 0, "user", "same"), (5, None, None, None), (5, 1, "assistant", "")]
    make = lambda rows: spark.createDataFrame([(*r, "k") for r in rows], "pair_id long, turn long, role string, text string, part string")
    got = {r.pair_id: r for r in preference.assembled(preference.preference_segments(make(chosen), make(rejected))).collect()}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert set(got) == {1, 2, 4, 5}
    assert got[1].prompt == show("user", "Hi") + show("assistant", "Yes") + show("user", "Why")
    assert got[1].chosen == show("assistant", "Because") and got[1].rejected == show("assistant", "No") + show("user", "ok")
    seen = lambda text, spans: [text[s.train_start : s.train_start + s.train_length] for s in spans]
    assert seen(got[1].chosen, got[1].chosen_spans) == ["Because<|im_end|>\n"] and seen(got[1].rejected, got[1].rejected_spans) == ["No<|im_end|>\n"]
    assert (got[2].prompt, got[2].chosen, got[2].rejected, got[2].chosen_spans) == ("", show("user", "a"), show("system", "a"), [])
    assert (got[4].prompt, got[4].chosen, got[4].rejected) == ("", show("user", "only"), "")
    assert got[5].prompt == show("", "") and seen(got[5].rejected, got[5].rejected_spans) == ["<|im_end|>\n"]
    assert preference.preference_segments(make(chosen).limit(0), make(rejected).limit(0)).count() == 0


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(preference, "SLICE", 7)
    a = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(100)]
    b = a[:63] + [(1, i, "assistant", f"u{i}" * 3) for i in range(63, 90)]
    make = lambda rows: spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")
    r = preference.assembled(preference.preference_segments(make(a), make(b))).first()
    show = lambda rows: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, _, role, text in rows)
    assert (r.prompt, r.chosen, r.rejected) == (show(a[:63]), show(a[63:]), show(b[63:]))
    assert [r.rejected[s.train_start : s.train_start + s.train_length] for s in r.rejected_spans] == [f"{t}<|im_end|>\n" for *_, t in b[63:]]


def test_swapped_answers_corners(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (3, 0, "user", None), (3, 1, "assistant", None), (3, 2, "user", "z"), (None, 0, "assistant", "q"), (4, None, "assistant", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = preference.swapped_answers(df)
    assert sorted(map(tuple, a.select("pair_id", "turn").collect())) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    assert {(r.pair_id, r.text) for r in b.where("turn = 1").collect()} == {(1, ""), (3, "b")}
    a, b = preference.swapped_answers(df.limit(0))
    assert a.count() == 0 == b.count()


# --- pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline as cp

    sf, out = "/root/testdata/sf0.01", str(tmp_path_factory.mktemp("stages"))
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        found.append(docs)
        stage(spark, docs, sf).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return sf, [*found, docs]


def test_stages_against_plain_versions(spark, stages):
    from test_simhash import plain_components, plain_fingerprint

    from skyloom.llm.queries import LANGUAGE_WEIGHTS

    sf, (raw, good, single, near, mix, packed) = stages
    assert all(df.columns == raw.columns for df in (good, single, near, mix))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    known = [labels[r.doc_id] == (r.doc_id in kept) for r in raw.select("doc_id").collect() if r.doc_id in labels]
    assert np.mean(known) > 0.98
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    firsts = {}
    for i, text in sorted(kept.items()):
        firsts.setdefault(low(text), i)
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted(firsts.values())
    prints = [(i, plain_fingerprint(kept[i] or "")) for i in sorted(firsts.values())]
    roots = plain_components(prints)
    left = sorted(r.doc_id for r in near.select("doc_id").collect())
    assert left == sorted({r for r in roots.values()})
    drawn = [r.doc_id for r in mix.select("doc_id").collect()]
    assert len(drawn) == len(set(drawn)) and set(drawn) <= set(left) and len(drawn) > 0.7 * len(left)
    tokens = {r.doc_id: (r.n, r.m) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()}
    assert set(tokens) == set(drawn) and all(n == m for n, m in tokens.values())
    sizes = [r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert max(sizes) <= 4096 and sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes) <= 0.01 * sum(sizes)
    assert list(LANGUAGE_WEIGHTS) == ["en", "de", "fr", "es"]


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline as cp

    sf, frames = stages
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "doc_tokens").collect()))
    got = cp.run(spark, sf)
    assert got.agg(F.sum("length")).first()[0] == frames[-1].agg(F.sum("length")).first()[0]
    assert {r[0] for r in key(got)} == {r[0] for r in key(frames[-1])}


def test_sides_that_number_turns_differently(spark):
    from skyloom.llm.preference import preference_segments

    side = lambda numbers, last: spark.createDataFrame(
        [(1, n, r, t) for n, (r, t) in zip(numbers, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", last)])],
        "pair_id long, turn long, role string, text string",
    )
    for numbers in ([1, 2, 3, 4], [0, 1, 5, 9]):
        rows = preference_segments(side([0, 1, 2, 3], "x"), side(numbers, "y")).collect()
        assert sorted((r.part, r.position, r.rendered[-12:-11]) for r in rows) == [
            ("chosen", 0, "x"), ("prompt", 0, "a"), ("prompt", 1, "b"), ("prompt", 2, "c"), ("rejected", 0, "y"),
        ]

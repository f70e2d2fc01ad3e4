from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyloom.llm import cutting_stock, packing, word_bpe
from skyloom.llm.queries import tokenizer_path
from skyloom.llm.word_bpe import ChunkEncoder

SF = "/root/testdata/sf0.001"
WORDS = tokenizer_path("word_bpe_49k.json")
ODD = ["", "  \n", "It's they'll A1b2 'S 'RE x'd", "ÀÉÎ ß Straße ÿ×÷ª²", "İstanbul ΣΑΣ ǅ e\u0301 \u00a0x\u2003y\x1cz \x85", "<|endoftext|> a<|startoftext|>b <|endof", "日本語 😀👍🏽 ﬁ Ａ", "\x00\x07 \u200b"]


@pytest.fixture(scope="module")
def coder():
    return ChunkEncoder(WORDS)


def test_ids_are_the_tokenizers(coder):
    texts = [t or "" for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()] + ODD + [" ".join(ODD)]
    for t in texts:
        got = np.frombuffer(coder.encode(t.encode()), coder.dtype).tolist()
        assert got == coder.tokenizer.encode(t, add_special_tokens=False).ids, t[:80]


def test_words_met_again_are_not_merged_again(monkeypatch):
    """However many others come between, in capitals and next to signs."""
    monkeypatch.setattr(word_bpe, "REMEMBERED", 12)
    coder, merged = ChunkEncoder(WORDS), []
    model = coder.model
    coder.model = type("Model", (), {"tokenize": staticmethod(lambda word: merged.append(word) or model.tokenize(word))})
    for k in range(40):
        text = f"thorined Thorined THORINED, thorined!! (thorined) s'thorined {'abcdefghij'[k % 10] * (k // 10 + 2)}"
        assert np.frombuffer(coder.encode(text.encode()), coder.dtype).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert [merged.count(w) for w in ("thorined", "!!", "(", "s")] == [1, 1, 1, 1] and len(coder) + len(coder.older) <= 24


def whole(rows, docs, coder, length):
    """Every id in one piece, sequences gapless; gives the tokens of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        want = coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        got = sorted(by_doc[i], key=lambda r: r.start)
        assert all(r.doc_tokens == len(want) and r.length > 0 for r in got)
        at = 0
        for r in got:
            assert r.start == at
            assert np.frombuffer(r.ids, "<u4").tolist() == want[at : at + r.length]
            at += r.length
        assert at == len(want)
    padding = 0
    for part in by_sequence.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_pieces_hold_every_id_once(spark, coder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, WORDS).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert whole(rows, texts, coder, 4096) <= 0.005 * sum(r.length for r in rows)


def test_corners(spark, coder):
    texts = {1: None, 2: "", 3: "one", 4: "long words here " * 3000, 5: "x", 6: "a b c " * 41}
    df = spark.createDataFrame([(i, t, "r", 7) for i, t in texts.items()], "doc_id long, text string, row string, n int")
    assert whole(packing.pack(df, WORDS, length=256).collect(), texts, coder, 256) == 0
    assert packing.pack(df.limit(0), WORDS).count() == 0
    twice = packing.pack(df.where("doc_id < 4").unionAll(df.where("doc_id < 4")), WORDS)
    assert twice.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> 2 * m").count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, WORDS, length=100)


def test_knapsack_against_all_patterns():
    rng = np.random.default_rng(0)
    for _ in range(20):
        price = rng.random(6) * (rng.random(6) > 0.3)
        counts, value = cutting_stock.best_pattern(price, 13)

        def best(space, k=0):
            return max([n * price[k] + best(space - n * (k + 1), k + 1) for n in range(space // (k + 1) + 1)]) if k < 6 else 0.0

        assert counts @ np.arange(1, 7) <= 13 and abs(value - best(13)) < 1e-9 and abs(counts @ price - value) < 1e-9


def test_linear_program_is_near_its_bound():
    rng = np.random.default_rng(1)
    demand = np.bincount(np.minimum(60, rng.integers(5, 64, 20_000)), minlength=61)[1:]
    patterns, uses = cutting_stock.relaxed(demand, 64)
    assert np.allclose(uses @ patterns, demand, atol=1e-6)
    asked = np.flatnonzero(demand)
    price = np.zeros(60)
    price[asked] = np.linalg.solve(patterns[:, asked].astype(float), np.ones(len(asked)))
    dearest = cutting_stock.best_pattern(np.maximum(price, 0), 64)[1]
    assert dearest <= 1 + 2 * cutting_stock.GAP  # prices over their dearest pattern bound every solution from below
    assert abs(price @ demand - uses.sum()) < 1e-6 * uses.sum()
    taken = sum(counts * times for counts, times in cutting_stock.plan(demand, 64, 0.99))
    assert (taken <= demand).all()
    assert cutting_stock.plan(np.zeros(5, int), 8, 0.9) == []


def test_patterns_take_no_worker_of_their_own(spark, monkeypatch):
    """Rows of Python objects are read by a second kind of worker, which stays in each executor's memory."""
    plans, stored = [], packing.stored
    monkeypatch.setattr(packing, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df))
    packing.pieces(stored(spark.range(3000).selectExpr("id AS row", "id % 700 + 1 AS n")))
    assert any("LocalRelation" in p for p in plans) and not any("LogicalRDD" in p for p in plans)

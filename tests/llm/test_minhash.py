from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from skyloom.llm import group_links, minhash as M, shingle_sets as S


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]


def plain(docs):
    """{id: (set size, smallest id reachable)} by comparing all pairs of sets."""
    sets = {}
    for i, text in docs:
        words = words_of(text)
        sets[i] = frozenset(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    by_shingle = {}
    for i in ids:
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)
    for i in ids:
        both = {}
        for s in sets[i]:
            for j in by_shingle[s]:
                both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if j > i and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, n, size=60, edits=3):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(copy).upper() if rng.random() < 0.1 else "  ".join(copy))
    return out


def corpus():
    rng = random.Random(8)
    texts = [t for k in (1, 2, 3, 5, 40) for _ in range(6) for t in family(rng, k, rng.choice([20, 60, 200]), rng.choice([1, 2, 6]))]
    texts += ["a b", "A  b", "a b c", "c b a", "x", "x\n", "", None, " \t", "again " * 3000] + family(rng, 120, 80, 2)
    rng.shuffle(texts)
    return list(enumerate(texts, start=10))


@pytest.mark.parametrize("blocks", [(4_000, 2_000_000), (7, 400)])
def test_against_all_pairs(spark, blocks):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, key string, n int")
    want = plain(docs)
    rows = M.near_duplicates(df, list_block=blocks[0], cluster_block=blocks[1]).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert len({c for _, c in want.values()}) < 0.6 * len(want)


def test_nulls_and_repeats(spark):
    docs = [(5, "a b c d"), (5, "a b c d"), (3, "A B C D"), (None, "a b c d"), (None, "z z z"), (7, None), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (0, 2, 3, False), (0, 1, None, False), (7, 0, 7, True), (0, 0, None, False)], key=str)
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(5)
    a = [f"w{k}".encode() for k in range(400)]
    b = a[:370] + [f"v{k}".encode() for k in range(30)]
    values, counts = S.shingle_sets([b" ".join(a), b" ".join(b), b"", b"p q"], 3)
    both = len(np.intersect1d(values[: counts[0]], values[counts[0] : counts[0] + counts[1]]))
    assert counts.tolist() == [398, 398, 0, 1] and both == 368
    rows = S.signatures(values, counts, 2000)
    assert abs((rows[0] == rows[1]).mean() - both / (2 * 398 - both)) < 0.04 and rows.shape == (3, 2000)


@pytest.mark.parametrize("block", [1000, 6, 2])
def test_groups_in_blocks_lose_no_link(spark, block):
    rng = random.Random(block)
    groups = {g: [rng.randrange(300 if g else 40) for _ in range(60 if g % 2 else 9)] for g in range(8)}
    rows = [(g, 100 * g + k, v, len(vs)) for g, vs in groups.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "group long, node long, value long, size int")

    def close(values: pa.Array):
        x = values.to_numpy()
        return group_links.grown(len(x), lambda i, others: np.abs(x[others] - x[i]) <= 1)

    from skyloom.llm.components import Forest

    forest, want = Forest(), Forest()
    for r in group_links.links_in_groups(df, close, block).collect():
        forest.add([r.a], [r.b])
    for g, vs in groups.items():
        for i in range(len(vs)):
            for j in range(i):
                if abs(vs[i] - vs[j]) <= 1:
                    want.add([100 * g + i], [100 * g + j])
    assert all(forest.root(n) == want.root(n) for _, n, _, _ in rows)


def test_query_against_all_pairs(spark):
    from skyloom.llm.queries import op13_minhash_near_dedup as query

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in query(spark, sf).collect()} == plain(docs)

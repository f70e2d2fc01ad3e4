from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from skyloom.llm import periodic_runs as R

SF = "/root/testdata/sf0.001"


def plain(words):
    """All runs by trying every period: maximal stretches in which words q apart agree, smallest period only."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q) if q % d == 0):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    """The digest of one document, straight from the definition."""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def repetitive(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randint(1, 6)):
        block = [rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40]))]
        stretch = block * rng.randint(1, 12)
        words += stretch[: len(stretch) - rng.randrange(len(block))]
        words += [rng.choice("abc") for _ in range(rng.choice([0, 0, 1, 3, 30]))]
    return words


def test_runs_against_all_periods():
    texts = [[w.encode() for w in repetitive(k)] for k in range(300)] + [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"x", b"y"] * 5_000]
    assert R.runs_of_texts(texts) == [plain(t) for t in texts[:-1]] + [[(0, 10_000, 2)]]
    assert sum(map(len, R.runs_of_texts(texts))) > 100
    assert R.runs_of_texts([texts[5]]) == [plain(texts[5])]


def test_nested_and_tied_runs():
    block = [b"a"] * 30 + [b"b"]
    runs = R.runs_of_texts([block * 4])[0]
    assert (0, 124, 31) in runs and (0, 30, 1) in runs and (31, 30, 1) in runs
    assert R.strongest(runs) == (0, 30, 1)
    assert R.strongest([(5, 40, 4), (2, 30, 3), (2, 20, 2)]) == (2, 20, 2)
    assert R.kept_words(block * 4, runs) == [b"a", b"b"]


def test_columns_nulls_and_repeats(spark):
    docs = [(1, "x " * 40, "k", 7), (1, "x " * 40, "k", 7), (2, None, None, None), (3, "", "", 0), (None, "p q\t" * 30 + "ü", "", 0), (4, "A a " * 3 + "w\x0bw\x0c" * 30_000, "", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, runs string, best int")
    rows = {r.doc_id: r for r in R.periodic_runs(df).collect()}
    assert rows[1].runs == [(0, 40, 1)] and rows[1].collapsed == "x" and rows[2].n_words == 0 and rows[2].best is None and rows[3].collapsed == ""
    assert rows[None].best == (0, 60, 2) and rows[None].collapsed == "p q ü"
    assert rows[4].best == (6, 60_000, 1) and rows[4].collapsed == "A a A a A a w"
    assert R.periodic_runs(df).count() == len(docs) and R.periodic_runs(df.limit(0)).count() == 0


def test_gram_filter_names_every_text_with_a_repeat():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 2, n) for n in (10, 15, 16, 17, 40, 200, 400)]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    want = [k for k, t in enumerate(texts) if len({tuple(t[i : i + 16]) for i in range(len(t) - 15)}) < max(0, len(t) - 15)]
    assert set(want) <= set(R.repeats_a_gram(np.concatenate(texts), of).tolist())


def test_query_against_definition(spark):
    from skyloom.llm.queries import op12_periodic_runs as query

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in query(spark, SF).collect())
    assert got == sorted(row(*d) for d in docs) and sum(r[1] for r in got) > 10

from __future__ import annotations

import random
import re
from collections import Counter
from functools import cmp_to_key

import numpy as np
import pytest

from skyloom.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    often = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in often.items():
        inside = lambda v: len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))
        if any(g == lang and inside(v) and 100 * f >= 80 * a for (g, v), f in often.items()):
            continue
        score, k = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    rows, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return rows


def corpus():
    rng = random.Random(2)
    stock = ["new york city", "as far as i know", "New York", "état civil", "of the", "the end of the line"]
    docs = []
    for _ in range(160):
        parts = []
        for _ in range(rng.randint(1, 25)):
            parts.append(rng.choice(stock) if rng.random() < 0.5 else rng.choice("abcde of the in".split(" ") + ["a b"]))
            parts.append(rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "\x0c", "!"]))
        docs.append(("".join(parts), rng.choice(["en", "en", "de", None])))
    return docs + [(None, "en"), ("", None), (" \t.\n", "de"), ("go go " * 3000, "long")]


@pytest.mark.parametrize("least, top, bits", [(5, 2000, 1 << 20), (5, 7, 8), (2, 10**6, 1 << 12)])
def test_against_counting(spark, least, top, bits):
    docs = corpus()
    df = spark.createDataFrame([(t, g, "k", 1) for t, g in docs], "text string, lang string, phrase string, w int").repartition(5)
    want = plain(docs, least, top)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in C.collocations(df, least=least, top=top, filter_bits=bits).collect())
    assert got == sorted(want) and len(want) > 10
    assert C.collocations(df.limit(0)).count() == 0


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(1)
    parts = [rng.zipf(1.3, 4000).clip(0, 2**31).astype(np.uint32) for _ in range(12)]
    total, mass, least = Counter(np.concatenate(parts).tolist()), sum(map(len, parts)), 30
    keys, counts, gone = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    for p in parts:
        keys, counts, beyond = C.merged(np.concatenate((keys, p)), np.concatenate((counts, np.ones(len(p), np.int64))), mass // least + 1)
        gone += beyond
    held = dict(zip(keys.tolist(), counts.tolist()))
    assert 0 < gone < least and len(keys) <= mass // least + 1 < len(total)
    assert all(k in held for k, f in total.items() if f >= least)
    assert all(total[k] - gone <= c <= total[k] for k, c in held.items())


def test_large_numbers_stay_exact(spark):
    big = 4 * 10**18
    row = spark.createDataFrame([(big, big, big)], "a long, l long, r long")
    expr = "cast(2000000 as decimal(10, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))"
    assert row.selectExpr(f"{expr} AS s").first().s == 2_000_000 * big // (2 * big)

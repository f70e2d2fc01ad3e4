from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import simhash
from skyloom.llm.components import components


def plain_fingerprint(text: str) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    """rows: (id, fingerprint)."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, f in rows:
        for j, g in rows:
            if bin(f ^ g).count("1") <= 4:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i, _ in rows}


def test_fingerprint_by_its_definition():
    for text in ("", " \t\n", "Eins", "a b c", "A b C d", "Ä ä x Y\x0bz w q r s t " * 40, "the the the the the the"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_anchors_cover(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**32, 300)
    flips = [(1 << int(a)) ^ (1 << int(b)) if k % 3 else 1 << int(a) for k, (a, b) in enumerate(rng.integers(0, 32, (300, 2)))]
    df = spark.createDataFrame([(int(a), int(a) ^ f, int(a) ^ f ^ (1 << 5) ^ (1 << 17)) for a, f in zip(x, flips)], "x long, y long, z long")
    near = lambda c, r: simhash._anchors(F.col(c), r)
    got = df.select(
        F.arrays_overlap(near("x", 2), near("y", 2)).alias("two"), F.arrays_overlap(near("x", 3), near("z", 3)).alias("four"),
        F.size(near("x", 2)).alias("n2"), F.size(near("x", 3)).alias("n3"), F.size(F.array_distinct(near("x", 3))).alias("d3"),
    ).collect()
    assert all(r.two and r.four and r.n2 <= 17 and r.n3 == r.d3 for r in got)


@pytest.mark.parametrize("split_at", [20_000, 3])
def test_links_against_all_pairs(spark, split_at):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = set()
    for c in centres:
        v = int(c)
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    df = spark.createDataFrame([(i, int(np.uint64(v).astype(np.int64))) for i, v in rows], "node long, fp long")
    roots = dict(map(tuple, components(simhash.near_links(df, split_at=split_at)).collect()))
    assert {i: roots.get(i, i) for i, _ in rows} == plain_components(rows)


def test_query_against_all_pairs(spark):
    from skyloom.llm.queries import op2_simhash_near_dedup as query

    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, plain_fingerprint(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_components(texts)
    got = query(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", want[i]) for i, f in texts)


def test_corners(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "word", "z"), (3, "word", "z"), (None, "word", "q"), (None, "other", "q"), (5, "a b c d e " * 20_000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(df).collect()}
    assert got[1, "0" * 16] == 1 and got[2, "0" * 16] == 1
    word = f"{plain_fingerprint('word'):016x}"
    assert got[3, word] == 3 and got[None, word] == 3 and got[None, f"{plain_fingerprint('other'):016x}"] is None
    assert simhash.simhash_components(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in simhash.one_of_each(df).collect()) == [0, 0, 1, 3, 3, 5]


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

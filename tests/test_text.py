"""Tokens, vocabularies, encoding and decoding against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from skyloom.operators import text as tx

# fixed values: white space of the tokenizer
CODES = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
WHITE = "".join(map(chr, CODES))
# plain characters, and others next to white space
ODD = "aZ!~0" + "".join(map(chr, [8, 14, 27, 127, 134, 161, 5761, 8191, 8203, 8231, 8234, 8240, 8288, 12289, 0x1F600]))


def words(text):
    """Parts between white space, as the tokenizer knows it."""
    spaced = "".join(" " if c in WHITE else c for c in text or "")
    return [w for w in spaced.split(" ") if w]


def texts(count, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(WHITE if rng.random() < 0.3 else ODD) for _ in range(rng.randrange(40)))) for i in range(count)]
    return rows + [(count, None), (count + 1, ""), (count + 2, WHITE), (count + 3, "a " * 50_000)]


def numbers(rows, specials, least):
    counts = Counter(w for _, t in rows for w in words(t))
    ranked = sorted((w for w, n in counts.items() if n >= least), key=lambda w: (-counts[w], w.encode()))
    return {s: i for i, s in enumerate(specials)} | {w: i + len(specials) for i, w in enumerate(ranked)}


def test_tokens_of_odd_characters(spark):
    rows = texts(300, 1)
    got = spark.createDataFrame(rows, "id long, text string").select("id", tx.tokenize("text").alias("t")).collect()
    wanted = dict(rows)
    assert all((r["t"] or []) == words(wanted[r["id"]]) for r in got) and len(got) == len(rows)


def test_encode_and_decode(spark):
    """One token fills well over 40 % of the corpus; nulls, empty texts and tokens outside the vocabulary occur."""
    rows, marks = texts(300, 2), ["<unk>", "<s>", "</s>"]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = tx.build_vocab(df, "text", specials=marks, min_freq=2)
    ids = numbers(rows, marks, 2)
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == ids
    coded = tx.encode(df, "id", "text", vocab, specials=marks, bos="<s>", eos="</s>")
    got = {r["id"]: r for r in coded.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["input_ids"] == [1, *[ids.get(w, 0) for w in words(t)], 2] and got[i]["length"] == len(words(t)) + 2
    back = {r["id"]: r["text"] for r in tx.decode(coded, "id", "input_ids", vocab, exclude=[0, 1, 2]).collect()}
    assert back == {i: " ".join(w for w in words(t) if w in ids) for i, t in rows}
    short = tx.encode(df, "id", "text", vocab, l_max=6, specials=marks, bos="<s>").collect()
    assert all(r["input_ids"] == [1, *[ids.get(w, 0) for w in words(dict(rows)[r["id"]])[:5]]] for r in short)


def test_only_distinct_tokens_meet_the_vocabulary(spark):
    """The hot token reaches the join once per block, and the join sees no row per token."""
    df = spark.range(400).select(F.col("id"), F.concat(F.repeat(F.lit("hot "), 200), F.lit("w"), F.col("id")).alias("text"))
    vocab = tx.build_vocab(df, "text")
    seen = tx._looked_up(df, "id", tx.tokenize("text"), F.octet_length("text"), vocab, "token", "token_id", 0)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and plan.index("Aggregate [_block") < plan.index("array_distinct")
    assert sorted(r["n"] for r in seen.select(F.size("_found").alias("n")).distinct().collect()) == [201]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    vocab = tx.build_vocab(df, "text", specials=["<unk>"])
    assert [r["token"] for r in vocab.collect()] == ["<unk>"]
    assert tx.encode(df, "id", "text", vocab).collect() == []
    assert tx.decode(df.select("id", F.array(F.lit(1)).alias("a")), "id", "a", vocab).collect() == []

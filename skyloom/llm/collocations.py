"""Phrases whose words keep together, mined with mergeable Misra-Gries summaries per hash partition.

First pass: n-grams of 2 to 4 words are hashed; each task counts what it holds and sends a summary to every partition of
the hash space. A partition merges summaries under a capacity above its mass divided by the threshold: sum the counters,
subtract the first one beyond the capacity from all, drop what is not positive. All subtractions together stay below the
threshold, so every frequent n-gram survives. A partition's mass is known before its first summary: masses sort first.

Survivors are marked in a bit table of fixed size, one stretch per partition; it is all that reaches the driver and is
sent to the tasks. A full table only lets more pass. Second pass: n-grams with a mark, and whose parts have marks, are
counted exactly by their words. Scores, cuts and the rule of longer phrases are joins over the frequent phrases alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skyloom.llm.common import partitions, stored
from skyloom.llm.periodic_runs import Numbers
from skyloom.llm.shingle_sets import mixed
from skyloom.skew import join_counted

LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a phrase
COVERED = (80, 100)  # share of a phrase's occurrences inside a longer one at which it is dropped
TOP = 2000  # phrases reported per language
SCALE = 2_000_000
FILTER_BITS = 1 << 27  # marks of survivors, at any size of the corpus
BYTES_AT_ONCE = 3 << 20
_FOLD = bytearray(range(256))
_FOLD[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = 10  # ends a piece
_FOLD[9] = 32
_FOLD = bytes(_FOLD)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


class Stretch:
    """The words of some texts of one language: numbered words, with breaks between pieces."""

    def __init__(self, lang: str, texts: list[bytes]):
        import xxhash

        number = Numbers({b"": 0, b"\n": 1})
        words = b"\n".join(texts).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        del words
        self.lang, self.ids, self.words = lang, ids[ids != 0], list(number)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 2: where n-grams inside a piece begin, and their hashes."""
        one = self.hashes[self.ids]
        h, bad = one, self.ids == 1
        for n in range(2, LONGEST + 1):
            with np.errstate(over="ignore"):
                h = h[:-1] * _MULTIPLIER + one[n - 1 :]
            bad = bad[:-1] | (self.ids[n - 1 :] == 1)
            at = np.flatnonzero(~bad)
            yield n, at, mixed(h[at] + np.uint64(n))


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Stretch]]:
    """Texts by language, of about ``BYTES_AT_ONCE`` bytes together. Columns: language, text."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py().translate(_FOLD)
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= BYTES_AT_ONCE:
                yield [Stretch(k, v) for k, v in held.items()]
                held, size = {}, 0
    if held:
        yield [Stretch(k, v) for k, v in held.items()]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def merged(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One Misra-Gries summary of several, put one after another: keys, counts, and what was subtracted."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    beyond = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    counts = counts - beyond
    return keys[counts > 0], counts[counts > 0], beyond


def summaries(rows: DataFrame, parts: int) -> DataFrame:
    """``part, kind, mass, ones, keys, counts``: for each part the mass a task sends (kind 0), and its counters (kind 1):
    32-bit keys of n-grams seen once, and of others with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("ones", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
        mass = np.zeros(parts, np.int64)
        borders = np.array([-(-p * 2**32 // parts) << 32 for p in range(1, parts)], np.uint64)
        for held in stretches(batches):
            found = [h for s in held for _, _, h in s.grams()]
            h = np.concatenate(found)
            del found
            h.sort()
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate((first, [len(h)])))
            cuts = np.concatenate(([0], np.searchsorted(h, borders), [len(h)]))
            mass += np.diff(cuts)
            h = h[first]
            cuts = np.concatenate(([0], np.searchsorted(h, borders), [len(h)]))
            low, once = h.astype(np.uint32), counts == 1
            out = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                here = slice(cuts[p], cuts[p + 1])
                k, c, o = low[here], counts[here], once[here]
                out.append((p, 1, 0, k[o].tobytes(), k[~o].tobytes(), c[~o].astype(np.int64).tobytes()))
            if out:
                yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*out), kinds)], schema=kinds)
        at = np.flatnonzero(mass)
        nothing = pa.nulls(len(at), pa.binary())
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.zeros(len(at)), pa.int32()), pa.array(mass[at]), nothing, nothing, nothing], schema=kinds)

    return rows.mapInArrow(run, "part int, kind int, mass long, ones binary, keys binary, counts binary")


def survivors(found: DataFrame, least: int, bits: int) -> DataFrame:
    """``part, marks, n``: merged summaries as a compressed stretch of ``bits`` marks, and how many keys survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, waiting, held, gone = None, 0, [], 0, 0

        def merge(capacity: int) -> None:
            nonlocal waiting, held, gone
            keys, counts, beyond = merged(np.concatenate([k for k, _ in waiting]), np.concatenate([c for _, c in waiting]), capacity)
            waiting, held, gone = [(keys, counts)], len(keys), gone + beyond

        def finish() -> pa.RecordBatch:
            if waiting:
                merge(mass // least + 1)
            keys, counts = waiting[0] if waiting else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            keys = keys[counts + gone >= least]  # an n-gram occurred so often at most
            marks = np.zeros(bits, bool)
            marks[(keys.astype(np.uint64) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)] = True
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([zlib.compress(np.packbits(marks).tobytes(), 1)]), pa.array([len(keys)], pa.int64())], names=["part", "marks", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if part is not None:
                        yield finish()
                    part, mass, waiting, held, gone = row["part"], 0, [], 0, 0
                if row["kind"] == 0:
                    mass += row["mass"]
                    continue
                ones = np.frombuffer(row["ones"], np.uint32)
                waiting.append((ones, np.ones(len(ones), np.int64)))
                waiting.append((np.frombuffer(row["keys"], np.uint32), np.frombuffer(row["counts"], np.int64)))
                held += len(waiting[-1][0]) + len(ones)
                if held > 4 * (mass // least + 1) + 100_000:
                    merge(mass // least + 1)
        if part is not None:
            yield finish()

    spread = found.repartition(partitions(found.sparkSession), "part").sortWithinPartitions("part", "kind")
    return spread.mapInArrow(run, "part int, marks binary, n long")


def counted(rows: DataFrame, marks, parts: int, bits: int) -> DataFrame:
    """``lang, words, phrase, f``: partial exact counts of words and of marked n-grams; ``words`` 0 is all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks.value, np.uint8)

        def batch_of(lang: str, n: int, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
            size = len(phrases)
            columns = [pa.array([lang] * size, pa.string()), pa.array(np.full(size, n), pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
            return pa.record_batch(columns, names=["lang", "words", "phrase", "f"])

        for held in stretches(batches):
            for s in held:
                total = np.bincount(s.ids, minlength=len(s.words))
                seen = np.flatnonzero(total[2:]) + 2
                yield batch_of(s.lang, 0, [b""], [total[2:].sum()])
                yield batch_of(s.lang, 1, [s.words[i] for i in seen.tolist()], total[seen])
                known = s.ids  # numbers of the shorter n-grams by place, exact; below 0: cannot be frequent
                for n, at, h in s.grams():
                    bit = part_of(h, parts) * np.uint64(bits) + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32))
                    marked = table[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8) & 1
                    at = at[(marked == 1) & (known[at] >= 0) & (known[at + 1] >= 0)]
                    _, where, place, counts = np.unique(known[at] * len(s.words) + s.ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                    known = np.full(len(s.ids) + 1, -1, np.int64)
                    known[at] = place
                    words = s.words
                    phrases = [b" ".join([words[i] for i in row]) for row in s.ids[at[where][:, None] + np.arange(n)].tolist()]
                    yield batch_of(s.lang, n, phrases, counts)

    return rows.mapInArrow(run, "lang string, words int, phrase string, f long")


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, least: int = LEAST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang, words, phrase, f``, stored: all phrases of 1 to ``LONGEST`` words that occur ``least`` times, and with
    ``words`` 0 the number of all words of each language."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    parts = partitions(spark)
    bits = max(8, filter_bits // parts // 8 * 8)
    marks = bytearray(parts * bits // 8)
    for r in survivors(summaries(rows, parts), least, bits).collect():  # ``filter_bits`` at most
        marks[r["part"] * bits // 8 : (r["part"] + 1) * bits // 8] = zlib.decompress(r["marks"])
    partial = counted(rows, spark.sparkContext.broadcast(bytes(marks)), parts, bits)
    return stored(partial.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0)))


def _words(first, length):
    return F.array_join(F.slice("w", first, length), " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts a phrase, ``l`` and ``r`` the parts of the cut with the lowest score, floor(2000000 a / (l + r)); ``n``
    counts the words of the language. Phrases stay inside pieces; A-Z are lower-cased. Null and empty texts have no words,
    a null language is ``und``. Rows count each, ids do not matter, other columns are ignored; an empty table gives an
    empty result. Ties go to the smallest cut, then to the more frequent phrase, then to byte order.
    """
    table = frequent_phrases(docs, text_col, lang_col, least, filter_bits)
    phrases = table.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "words", "f", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    halves = F.array(F.struct(F.lit(0).alias("side"), _words(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), _words(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))
    asked = stored(cuts.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(halves).alias("h")).select("lang", "phrase", "a", "k", "h.*"))
    wanted = asked.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("copies"))
    known = table.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    parts = join_counted(asked, stored(known.join(wanted, ["lang", "part"])), ["lang", "part"], "copies")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("of")))
    scored = parts.groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: _words(i, n))))
    longer = phrases.where("words > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    share, whole = COVERED
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") * whole < F.col("a") * share))
    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    left = left.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)  # before a language meets in one task
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = table.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")

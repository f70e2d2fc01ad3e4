"""Runs of words that repeat periodically, by Kruskal over suffix classes in descending LCP.

Suffixes of a text are ranked by prefix doubling; neighbours in suffix order are united in order of decreasing LCP, each
class keeping the ordered set of its positions. When two positions become neighbours in their class at level ``v``, the
words from both agree for exactly ``v`` words; if they are at most ``v`` apart, the stretch from the first one has their
distance as its smallest period, and if the word before breaks the period, it is a run, complete in length.

A run of at least ``LEAST`` words and three periods repeats 16 words at a distance of its period, so texts without a
repeated 16-word gram need no suffix order, and lower levels are never united. Documents are judged where they are read:
nothing is shuffled, and texts of one batch share their sorts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST, PERIODS = 24, 3  # a run has this many words and periods at least
GRAM = 16  # words that both places of a run agree in: the least of max(24, 3 q) - q
WORDS_AT_ONCE = 200_000  # a longer text is a batch of its own
_MULTIPLIER = 0x9E3779B97F4A7C15


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeats_a_gram(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Numbers of the texts (``of``, never falling) that may hold ``GRAM`` equal words at two places; may name too many."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER)
        h ^= h >> np.uint64(31)
        power, length = np.uint64(0xD6E8FEB86659FD93), 1
        while length < GRAM:
            h = h[:-length] * power + h[length:]
            power, length = power * power, 2 * length
        if not len(h):
            return np.zeros(0, np.int64)
        own = of[: len(h)]
        h = (h ^ (h >> np.uint64(29)) ^ own.astype(np.uint64) * np.uint64(_MULTIPLIER))[own == of[GRAM - 1 :]]
        own = own[own == of[GRAM - 1 :]]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    return np.unique(own[order[same]])


def suffix_levels(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... words from each place, until they differ. ``ids`` ends in a word of its own."""
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    n, length = len(ids), 1
    while ranks[-1].max() + 1 < n:
        now = ranks[-1].astype(np.int64)
        behind = np.full(n, -1, np.int64)
        behind[: n - length] = now[length:]
        ranks.append(np.unique(now * (n + 1) + behind + 1, return_inverse=True)[1].astype(np.int32))
        length *= 2
    return ranks


def neighbour_lcp(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order, and how many words each shares with the one before it (first: 0)."""
    n = len(ranks[0])
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        step = same.astype(np.int64) << k
        a, b, shared = a + step, b + step, shared + step
    return order, np.concatenate(([0], shared))


def runs_by_descending_lcp(ids: np.ndarray, least: int = LEAST, periods: int = PERIODS, lowest: int = GRAM) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs in ``ids``, whose texts end in words that occur once.

    ``lowest`` may not exceed ``max(least, periods q) - q`` for any period ``q``; periods are at least 2.
    """
    order, lcp = neighbour_lcp(suffix_levels(ids))
    at = np.flatnonzero(lcp >= lowest)
    at = at[np.argsort(-lcp[at], kind="stable")]
    words = ids.tolist()
    up: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    found = []

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def seed(i: int, j: int, v: int) -> None:
        q = j - i
        if v + q >= max(least, periods * q) and (i == 0 or words[i - 1] != words[j - 1]):
            found.append((i, v + q, q))

    for x, y, v in zip(order[at - 1].tolist(), order[at].tolist(), lcp[at].tolist()):
        x, y = root(x), root(y)
        large, small = places.pop(x, None) or [x], places.pop(y, None) or [y]
        if len(large) < len(small):
            large, small, x, y = small, large, y, x
        cuts, n, last = [bisect_left(large, p) for p in small], len(small), len(large)
        for k, (p, cut) in enumerate(zip(small, cuts)):
            if cut and (not k or small[k - 1] < large[cut - 1]):
                seed(large[cut - 1], p, v)
            if cut < last and (k + 1 == n or small[k + 1] > large[cut]):
                seed(p, large[cut], v)
        if n * 16 < last:
            for p, cut in zip(reversed(small), reversed(cuts)):
                large.insert(cut, p)
        else:
            large = sorted(large + small)
        up[y] = x
        places[x] = large
    return found


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """All runs of each text, given as words, by start and period."""
    out: list[list] = [[] for _ in texts]
    number = Numbers()
    sizes = np.array([len(t) for t in texts])
    ids = np.fromiter((n for t in texts for n in map(number.__getitem__, t)), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    wanted = [k for k in repeats_a_gram(ids, np.repeat(np.arange(len(texts)), sizes)).tolist() if sizes[k] >= LEAST]
    if not wanted:
        return out
    parts, ends, at = [], [], 0
    for n, k in enumerate(wanted):
        parts += [ids[starts[k] : starts[k] + sizes[k]], np.array([len(number) + n])]
        ends.append(at := at + int(sizes[k]) + 1)
    first = [0, *ends[:-1]]
    for start, length, period in runs_by_descending_lcp(np.concatenate(parts)):
        n = int(np.searchsorted(ends, start, side="right"))
        out[wanted[n]].append((start - first[n], length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, exactly; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2] or run[1] * best[2] == best[1] * run[2] and (run[0], run[2]) < (best[0], best[2]):
            best = run
    return best


def repeating_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a document with its tail overwritten by a period, for one id in ten (by crc32): planted runs."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head, block = words[:a], words[a : a + p]
    return head + (block * ((n - a) // p + 1))[: n - a]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``runs`` (start, length, period; by start, then period),
    ``best`` (the one with most periods, null without runs) and ``collapsed`` (text without what runs repeat, words
    joined by one space).

    Words are split at ASCII white space and compared as they are. ``prepare`` may change the words of an id first. Null
    and empty texts have no words. Repeated rows and null ids are judged each; other columns are ignored; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            found = runs_of_texts(texts)
            as_dict = lambda r: r and dict(zip(("start", "length", "period"), r))
            kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            return pa.record_batch([
                pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[as_dict(r) for r in runs] for runs in found], pa.list_(kind)),
                pa.array([as_dict(strongest(runs)) for runs in found], kind),
                pa.array([b" ".join(kept_words(t, runs)).decode() for t, runs in zip(texts, found)], pa.string()),
            ], names=["id", "n_words", "runs", "best", "collapsed"])

        for batch in batches:
            id_type, ids, texts, total = batch.schema.field(0).type, [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                key, words = key.as_py(), text.as_py().split()
                if prepare is not None:
                    words = prepare(key, words)
                if total + len(words) > WORDS_AT_ONCE and ids:
                    yield out(ids, texts)
                    ids, texts, total = [], [], 0
                ids.append(key)
                texts.append(words)
                total += len(words)
            if ids:
                yield out(ids, texts)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    run_type = "struct<start: long, length: long, period: long>"
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, n_words long, runs array<{run_type}>, best {run_type}, collapsed string")
    return found.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``periodic_runs`` in numbers: count, the best run, checksums of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

"""SimHash near-deduplication by anchor points of a covering code.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 2 bits in one of their halves of 32. Anchors of a
half are the words of a perfect Hamming code over 31 bits with a free 32nd bit: the code covers every word within radius
1. Halves at most 2 bits apart have a word within 1 bit of both, and that word's anchor is within radius + 1 bits of
both. So each half goes to all anchors within 2 bits (17 of 2^27), fingerprints are compared per anchor, and no link is
lost. Going out to radius + 2 from one side only would need 171 anchors per half, to radius + 4 on the whole word 81,000.

Equal fingerprints are one node from the start. Within an anchor, links are found by growing components, not by listing
pairs, and each task hands on only a forest of what it has found. Anchors with very many fingerprints are split by the
anchors of the other half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyloom.llm.common import partitions, stored
from skyloom.llm.components import Forest, components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
SPLIT_AT = 20_000  # fingerprints at one anchor beyond which it is split
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 50_000


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the 4-word shingles of a UTF-8 text (repeats count; fewer words: one shingle; none: zero)."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        last = ends[lo + SHINGLE - 1 : hi + SHINGLE - 1] if len(words) >= SHINGLE else ends[-1:]
        found = [digest(line[i:j], SEED) for i, j in zip(starts[lo:hi].tolist(), last.tolist())]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's 64 bits as a signed long) of every row; null text is empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _bit(place: Column) -> Column:
    """2 to the power ``place - 1``, as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))


def _anchors(half: Column, reach: int) -> Column:
    """All anchors within ``reach`` (2 or 3) bits of a 32-bit half."""
    word, top = half.bitwiseAND((1 << 31) - 1), half.bitwiseAND(1 << 31)
    odd = lambda k: F.bit_count(word.bitwiseAND(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1))).bitwiseAND(1)
    s = sum((odd(k) * (1 << k) for k in range(1, 5)), odd(0)).cast("int")  # 0 for code words, else the place to flip
    home = F.when(s == 0, word).otherwise(word.bitwiseXOR(_bit(F.greatest(s, F.lit(1)))))
    places = F.sequence(F.lit(1), F.lit(31))
    # two flips reach a code word if their places add up (bitwise) to s
    two = F.transform(
        F.filter(places, lambda i: (i < i.bitwiseXOR(s)) & (i != s)), lambda i: word.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(s)))
    )
    near1 = F.array(home)  # within 1
    near2 = F.when(s == 0, near1).otherwise(F.concat(near1, two))  # within 2; a code word has no other one so close
    here = lambda found: F.transform(found, lambda a: a.bitwiseOR(top))
    flipped = lambda found: F.transform(found, lambda a: a.bitwiseOR(top).bitwiseXOR(1 << 31))
    if reach == 2:
        return F.concat(here(near2), flipped(near1))
    # three flips: two free places and the third that completes them, each set of places once
    third = lambda i, j: i.bitwiseXOR(j).bitwiseXOR(s)
    three = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(places, lambda j: (j > i) & (third(i, j) > j)),
        lambda j: word.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(j)).bitwiseXOR(_bit(third(i, j))),
    )))
    return F.concat(here(F.concat(near2, three)), flipped(near2))


def _halves() -> list[Column]:
    return [F.col("fp").bitwiseAND(0xFFFFFFFF), F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32))]


def replicas(nodes: DataFrame, split_at: int = SPLIT_AT) -> DataFrame:
    """``cell, fp, node``: every fingerprint at each anchor of its halves, large anchors split once more."""
    low, high = _halves()
    at = F.concat(
        F.transform(_anchors(low, 2), lambda a: F.struct(F.lit(0).alias("half"), a.alias("anchor"))),
        F.transform(_anchors(high, 2), lambda a: F.struct(F.lit(1).alias("half"), a.alias("anchor"))),
    )
    spread = nodes.select("fp", "node").repartition(partitions(nodes.sparkSession))  # few bytes become many rows
    placed = spread.select("fp", "node", F.explode(at).alias("at"))
    full = placed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_at).select("at", F.lit(True).alias("full"))
    tagged = placed.join(full, "at", "left")
    # the other halves of a linked pair differ in at most 4 bits: a word within 2 of both, its anchor within 3
    other = F.when(F.col("at.half") == 0, high).otherwise(low)
    cells = F.when(F.col("full"), _anchors(other, 3)).otherwise(F.array(F.lit(-1).cast("long")))
    return tagged.select("fp", "node", "at", F.explode(cells).alias("sub")).select(F.struct("at.half", "at.anchor", "sub").alias("cell"), "fp", "node")


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return both[:, 0].tolist(), both[:, 1].tolist()


def _grow(fp: np.ndarray, node: np.ndarray, forest: Forest, threshold: int) -> None:
    """Components of one group: each member meets only those that nothing has reached yet."""
    open_fp, open_node = fp, node
    while len(open_fp):
        front_fp, front_node = [open_fp[0]], [open_node[0]]
        open_fp, open_node = open_fp[1:], open_node[1:]
        while front_fp and len(open_fp):
            x, x_node = front_fp.pop(), front_node.pop()
            near = np.bitwise_count(open_fp ^ x) <= threshold
            if near.any():
                reached = open_node[near].tolist()
                forest.add([int(x_node)] * len(reached), reached)
                front_fp.extend(open_fp[near])
                front_node.extend(reached)
                open_fp, open_node = open_fp[~near], open_node[~near]


def links_of_groups(group: np.ndarray, fp: np.ndarray, node: np.ndarray, forest: Forest, threshold: int, small: int = 12) -> None:
    """Adds the links within each run of equal ``group`` numbers."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
    sizes = np.diff(cuts)
    size_at = np.repeat(sizes, sizes)
    found_a, found_b = [], []
    for gap in range(1, small):  # small groups, all at once: members so many places apart
        first = np.flatnonzero((group[:-gap] == group[gap:]) & (size_at[:-gap] <= small)) if gap < len(group) else []
        if not len(first):
            break
        first = first[np.bitwise_count(fp[first] ^ fp[first + gap]) <= threshold]
        found_a.append(node[first])
        found_b.append(node[first + gap])
    if found_a:
        forest.add(*_distinct_pairs(np.concatenate(found_a), np.concatenate(found_b)))
    for k in np.flatnonzero(sizes > small):
        _grow(fp[cuts[k] : cuts[k + 1]], node[cuts[k] : cuts[k + 1]], forest, threshold)


def near_links(nodes: DataFrame, threshold: int = THRESHOLD, split_at: int = SPLIT_AT) -> DataFrame:
    """``a, b``: links that connect exactly the nodes whose fingerprints are within ``threshold`` (at most 4) bits."""
    if not 0 <= threshold <= 4:
        raise ValueError("the anchors cover up to 4 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept = Forest(), None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            *cell, fp, node = now
            if not len(fp):
                continue
            new = np.zeros(len(fp), bool)
            for part in cell:
                new[1:] |= part[1:] != part[:-1]
            group = np.cumsum(new)
            last = int(np.searchsorted(group, group[-1]))  # the last cell may go on in the next batch
            links_of_groups(group[:last], fp[:last].view(np.uint64), node[:last], forest, threshold)
            kept = [x[last:] for x in now]
        if kept is not None:
            links_of_groups(np.zeros(len(kept[3]), np.int64), kept[3].view(np.uint64), kept[4], forest, threshold)
        a, b = forest.links()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed = replicas(nodes, split_at).repartition(partitions(nodes.sparkSession), "cell")
    flat = placed.select("cell.*", "fp", "node").sortWithinPartitions("half", "anchor", "sub")
    return flat.mapInArrow(run, "a long, b long").where("a <> b")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, split_at: int = SPLIT_AT
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id linked to it).

    Null text counts as empty: fingerprint zero, linked like any other. Rows that repeat an id are one document. A row
    with a null id has a fingerprint and joins a component through it only if others with an id share or near it, else
    its component is null. Ids are integers. Other columns are ignored; an empty table gives an empty result.
    """
    found = stored(fingerprints(docs, id_col, text_col))
    nodes = stored(found.groupBy("fp").agg(F.min("id").alias("node")))
    roots = components(near_links(nodes.where("node IS NOT NULL"), threshold, split_at))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(classes, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its component (rows without an id stay)."""
    parts = simhash_components(docs, id_col, text_col, threshold)
    gone = parts.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])

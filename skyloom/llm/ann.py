"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is built and cut into balanced parts: halved along main directions,
then refined by moving vectors to the part of most of their neighbours as long as sizes stay even. A small classifier
learns the part from the vector. It places every row of the table in its most probable part and sends each query to
several; how many is measured on the sample. Within a part, blocks of queries meet blocks of rows, scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skyloom.llm.common import stored

SAMPLE = 8192  # vectors that the index is fitted on, by smallest hash of the id
ROWS_PER_PART, MOST_PARTS = 512, 64
NEIGHBOURS = 10
AIM = 0.95  # recall on the sample that sets the number of parts a query goes to
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


@dataclass(frozen=True)
class Index:
    """A softmax over parts, and how many parts a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def odds(self, vectors: np.ndarray) -> np.ndarray:
        return unit(vectors) @ self.weights + self.bias


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, k: int, asked: np.ndarray) -> np.ndarray:
    """Places of the ``k`` rows of largest cosine for each asked place of the unit rows, itself left out."""
    x, out = x.astype(np.float32), np.empty((len(asked), k), np.int64)
    for lo in range(0, len(asked), 1024):
        own = asked[lo : lo + 1024]
        far = -(x[own] @ x.T)
        far[np.arange(len(own)), own] = 2
        out[lo : lo + 1024] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """Parts of even size (a power of two of them): each set is halved along its main direction."""
    part = np.zeros(len(x), np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ direction, kind="stable")]
            part[order[len(own) // 2 :]] += size
        size *= 2
    return part


def refined(part: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.1) -> np.ndarray:
    """Moves to the part of most neighbours, best gains first, while part sizes stay within ``slack`` of even."""
    part, n = part.copy(), len(part)
    high, low = int(np.ceil(n / parts * (1 + slack))), int(n / parts * (1 - slack))
    sources = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (sources, part[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), part[sources]), 1)
        goal = votes.argmax(axis=1)
        gain = votes[np.arange(n), goal] - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[goal[i]] < high and sizes[part[i]] > low:
                sizes[goal[i]] += 1
                sizes[part[i]] -= 1
                part[i], moved = goal[i], moved + 1
        if moved < n // 500:
            break
    return part


def classifier(x: np.ndarray, part: np.ndarray, parts: int, rounds: int = 150, rate: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by full-batch gradient steps with momentum."""
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    vw, vb, told = np.zeros_like(w), np.zeros_like(b), np.eye(parts)[part]
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - told) / len(x)
        vw, vb = 0.9 * vw - rate * (x.T @ error + 1e-5 * w), 0.9 * vb - rate * error.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def fit(sample: np.ndarray, parts: int, k: int) -> Index:
    """Index from a bounded sample of vectors (rows)."""
    x = np.unique(unit(sample), axis=0)
    k = min(k, len(x) - 1)
    while parts > 1 and len(x) < 16 * parts:
        parts //= 2
    if parts <= 1 or k < 1:
        return Index(np.zeros((sample.shape[1], 1)), np.zeros(1), 1)
    graph = nearest(x, min(NEIGHBOURS, len(x) - 1), np.arange(len(x)))
    part = refined(halved(x, parts), graph, parts)
    index = Index(*classifier(x, part, parts), 1)
    odds = index.odds(x)
    home, asked = odds.argmax(axis=1), np.arange(0, len(x), max(1, len(x) // 1000))
    order = np.argsort(-odds[asked], axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(asked), axis=0), axis=1)
    truth = home[nearest(x, k, asked)]  # parts in which the true neighbours lie
    needed = np.sort(np.take_along_axis(place, truth, axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(AIM * len(needed))) - 1)]) + 1
    return Index(index.weights, index.bias, probes)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of rows with an id and a finite vector that is not zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def placed(rows: DataFrame, index: Index, probes: int) -> DataFrame:
    """Each row at its ``probes`` most probable parts: ``part, id, v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = index.odds(_matrix(batch.column(1)))
            best = np.argsort(-odds, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(best)), best.shape[1]))
            yield pa.record_batch(
                [pa.array(best.ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["part", "id", "v"]
            )

    return rows.mapInArrow(run, "part int, id long, v array<double>")


def _block_search(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """The ``k`` best of a block for each query: largest cosine first, ties to the smaller id, an id once."""
    q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    rough = (q / q_norm[:, None]) @ (x / x_norm[:, None]).T
    rough[query_ids[:, None] == ids[None, :]] = -3
    out = []
    for i in range(len(q)):
        row = rough[i]
        edge = np.partition(row, -k)[-k] if len(row) > k else -2
        at = np.flatnonzero(row >= max(edge - 1e-9, -2))
        exact = (q[i] * x[at]).sum(axis=1) / (q_norm[i] * x_norm[at])
        order = np.lexsort((ids[at], -exact))
        found = ids[at][order]
        first = np.sort(np.unique(found, return_index=True)[1])
        if len(first) < k < len(at) and len(first) < len(np.unique(ids)) - 1:  # repeated ids took places: look at all
            every = np.flatnonzero(row > -2)
            exact = (q[i] * x[every]).sum(axis=1) / (q_norm[i] * x_norm[every])
            order = np.lexsort((ids[every], -exact))
            found, at = ids[every][order], every
            first = np.sort(np.unique(found, return_index=True)[1])
        for j in first[:k]:
            out.append((int(query_ids[i]), int(found[j]), float(exact[order][j])))
    return out


def search(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sample_rows: int = SAMPLE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query(id)`` holds the ``k`` nearest found among all others.

    Score is the cosine in double precision on the given vectors; ties go to the smaller id. Rows with a null id, a null
    or zero vector, or a null or non-finite component take no part; usable vectors of different lengths are an error. Rows
    that repeat an id count once. Other columns are ignored; no usable rows give no result.
    """
    rows = stored(usable(vectors, id_col, vector_col))
    spark = vectors.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()  # bounded
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if seen["least"] != seen["most"]:
        raise ValueError(f"vectors have {seen['least']} to {seen['most']} components: no cosine between them")
    parts, total = 1, seen["n"]
    while parts < MOST_PARTS and parts * 2 * ROWS_PER_PART <= total:
        parts *= 2
    index = fit(np.array([r.v for r in sample]), parts, k)

    table = stored(placed(rows, index, 1))
    queries = stored(placed(rows.where(is_query(F.col("id"))), index, index.probes))
    blocks = table.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("row_blocks"))
    blocks = blocks.join(queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks")), "part")
    blocks = F.broadcast(blocks)  # a row per part
    any_of = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(blocks, "part").withColumn("query_block", any_of(F.col("query_blocks"))).withColumn("row_block", all_of("row_blocks"))
    right = table.join(blocks, "part").withColumn("row_block", any_of(F.col("row_blocks"))).withColumn("query_block", all_of("query_blocks"))
    cell = ["part", "row_block", "query_block"]

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and given.num_rows:
            ids = lambda t: t.column("id").to_numpy()
            found = _block_search(ids(asked), _matrix(asked.column("v")), ids(given), _matrix(given.column("v")), k)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    pairs = left.select(*cell, "id", "v").groupBy(*cell).cogroup(right.select(*cell, "id", "v").groupBy(*cell))
    found = pairs.applyInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

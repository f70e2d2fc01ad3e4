"""Links among the members of groups of any size, without listing pairs.

A group is cut into blocks of bounded size. Its leader visits every block; a block finds the links among its members and
the leader. What a block connects to the leader is connected across all blocks; only the others, the strays, visit the
other blocks of their group in a second round. A group of near copies so costs one row per member, and no link between
two members is lost: both hang on the leader, or one of them is a stray and meets the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyloom.llm.common import partitions, stored
from skyloom.llm.components import Forest

#: Given the values of a cell, pairs of places that connect all members it links, found by growing from the first one.
Linker = Callable[[pa.Array], Iterator[tuple[int, int]]]


def grown(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs that connect what is near: each place meets only those that nothing has reached yet, the first place first.

    ``near(x, others)`` says which of the places ``others`` are linked with place ``x``.
    """
    order = np.arange(size)
    while len(order) > 1:
        front, order = [int(order[0])], order[1:]
        while front and len(order):
            x = front.pop()
            hit = near(x, order)
            if hit.any():
                reached = order[hit].tolist()
                yield from ((x, y) for y in reached)
                front += reached
                order = order[~hit]


def _cells(rows: DataFrame, link: Linker) -> DataFrame:
    """``group, own, a, b``: links of each cell (group, own); with a leader in it, ``b`` null for each stray ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, strays, kept = Forest(), ([], [], []), None

        def cell(part: pa.Table) -> None:
            node = part.column("node").to_pylist()
            pairs = list(link(part.column("value").combine_chunks()))
            forest.add([node[i] for i, _ in pairs], [node[j] for _, j in pairs])
            if not part.column("plain")[0].as_py():  # the leader comes first
                own = Forest()
                own.add([i for i, _ in pairs], [j for _, j in pairs])
                for i in range(1, len(node)):
                    if node[i] != node[0] and own.root(i) != own.root(0):
                        for to, x in zip(strays, (part.column("group")[0].as_py(), part.column("own")[0].as_py(), node[i])):
                            to.append(x)

        def cells(table: pa.Table, whole: bool) -> pa.Table:
            group, own = (table.column(c).to_numpy() for c in ("group", "own"))
            cuts = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(own) != 0)) + 1).tolist(), len(group)]
            for lo, hi in zip(cuts, cuts[1:] if whole else cuts[1:-1]):
                if hi - lo > 1:
                    cell(table.slice(lo, hi - lo))
            return table.slice(cuts[-2])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            kept = cells(now if kept is None else pa.concat_tables([kept, now]).combine_chunks(), False)
        if kept is not None:
            cells(kept, True)
        a, b = forest.links()
        names = ["group", "own", "a", "b"]
        nothing = lambda n, kind: pa.nulls(n, kind)
        yield pa.record_batch([nothing(len(a), pa.int64()), nothing(len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)
        group, own, node = strays
        yield pa.record_batch([pa.array(group, pa.int64()), pa.array(own, pa.int32()), pa.array(node, pa.int64()), nothing(len(node), pa.int64())], names=names)

    spread = rows.select("group", "own", "plain", "node", "value").repartition(partitions(rows.sparkSession), "group", "own")
    return spread.sortWithinPartitions("group", "own", "plain").mapInArrow(run, "group long, own int, a long, b long")


def links_in_groups(members: DataFrame, link: Linker, block: int) -> DataFrame:
    """``a, b``: links that connect exactly what ``link`` connects among the members of each group.

    ``members``: ``group`` and ``node`` (long), ``value``, and ``size`` (of the whole group, in any unit, the same in all
    its rows). A group beyond ``block`` of that unit is cut into blocks. ``members`` is read up to four times.
    """
    cells = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    cells = cells.withColumn("own", F.pmod(F.xxhash64("node", "group"), F.greatest("blocks", F.lit(1))).cast("int"))
    home = cells.withColumn("plain", F.lit(True))
    large = cells.where("blocks > 1")
    leaders = large.groupBy("group", "blocks").agg(F.min(F.struct(F.xxhash64("node"), "node", "value")).alias("l"))
    leaders = leaders.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.lit(False).alias("plain"), "l.node", "l.value")
    columns = ["group", "own", "plain", "node", "value"]
    first = stored(_cells(home.select(columns).unionByName(leaders), link))
    found, strays = first.where("b IS NOT NULL").select("a", "b"), first.where("b IS NULL").select("group", F.col("a").alias("node"))
    if strays.isEmpty():
        return found.where("a <> b")
    away = large.join(strays.distinct(), ["group", "node"])
    visits = away.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("at <> own")
    visits = visits.select("group", F.col("at").alias("own"), F.lit(True).alias("plain"), "node", "value")
    visited = large.withColumn("plain", F.lit(True)).join(strays.select("group").distinct(), "group").select(columns)
    second = _cells(visited.unionByName(visits), link).where("b IS NOT NULL").select("a", "b")
    return found.unionByName(second).where("a <> b")

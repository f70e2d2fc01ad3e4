"""Connected components by large-star and small-star steps.

Each step is a group-by with a map-side minimum and a join, so a node with very many links is never gathered in one
task. The links of a round are stored in the shared folder before the next one reads them. Nothing but a count and a
checksum per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyloom.llm.common import stored
from skyloom.session import made_since, remove_scratch, scratch_mark


class Forest:
    """Union-find over the links that one task has seen; hands on one link per node at most."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def add(self, a: list[int], b: list[int]) -> None:
        for x, y in zip(a, b):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def links(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node it sees."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    """Count and two checksums of a set of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node of ``links`` but the roots themselves.

    ``links`` has two comparable columns ``a`` and ``b``; order, repeats and self-links do not matter, nulls are no nodes.
    """
    spark = links.sparkSession
    mark = scratch_mark()
    now = stored(links.select("a", "b").where("a <> b").distinct())
    seen = _state(now)
    while seen[0]:
        before = scratch_mark()
        now = stored(_small_star(_large_star(now)))
        new = _state(now)
        remove_scratch(spark, mark, made_since(before))  # the rounds before
        if new == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

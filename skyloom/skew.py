"""Joins on keys that may hold a large share of the rows.

A key that holds more than one row in ``SHARE`` is heavy; there can be no more than ``SHARE`` of them, whatever the size of
the data, so their rows of the unique side are broadcast and the other side is not moved. All other rows are shuffled by
key, and no key is large any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SHARE = 10_000


def join_counted(rows: DataFrame, unique: DataFrame, on: list[str], copies: str, total: int | None = None, share: int = SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``unique``, which has one row per key and in ``copies`` how many of ``rows`` have it.

    ``copies`` is dropped. ``total`` is the sum of all ``copies``, counted if not given. Keys are equal null-safe. Both
    sides are read twice and should be stored.
    """
    if total is None:
        total = unique.agg(F.sum(copies).alias("n")).first()["n"] or 0
    heavy = F.col(copies) * F.lit(share) > F.lit(total)
    names = [f"_key{i}" for i in range(len(on))]
    extra = [c for c in unique.columns if c not in (*on, copies)]
    side = unique.withColumnsRenamed(dict(zip(on, names)))
    equal = lambda: [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(on, names)]
    few = F.broadcast(side.where(heavy).select(*names, F.struct(F.lit(1).alias("_one"), *extra).alias("_few")))  # at most ``share`` rows
    tagged = rows.join(few, equal(), "left").drop(*names)
    hot = tagged.where("_few IS NOT NULL").select(*[f"`{c}`" for c in rows.columns], *[F.col("_few")[c].alias(c) for c in extra])
    rest = tagged.where("_few IS NULL").drop("_few").join(side.where(~heavy), equal())
    return hot.unionByName(rest.select(*[f"`{c}`" for c in rows.columns], *extra))

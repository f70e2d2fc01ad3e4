"""Exact deduplication by content sort.

Texts are normalised (A-Z lower-cased, null as empty), cut at sampled splitters into ranges of their bytes, sorted
externally inside each range, and compared in full with their neighbours: equal texts are adjacent. Splitters hold only
the start of a text and, for texts that share it, a hash: the sample that reaches the driver stays small.

A text with very many copies would make one range as large as its group. Such texts are found first by an exact count
per 64-bit hash (counted map-side, one small row per distinct hash). Their rows skip the sort: the group is summed up
map-side by its whole text, and each copy looks its group up. The list of these texts is bounded: each has more than a
``1 / (4 * partitions)`` share of all rows, so there are fewer than ``4 * partitions`` of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skyloom.llm.common import ascii_lower, partitions

START = 48  # characters of a text that splitters look at
LEAST_COPIES = 64  # smaller groups are never worth an own way


def _rows(docs: DataFrame, id_col: str, text_col: str, payload: list[str]) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    kept = [F.struct(*[F.col(f"`{c}`") for c in payload]).alias("row")] if payload else []
    return docs.select(F.col(f"`{id_col}`").alias("id"), norm.alias("norm"), *kept).withColumn("hash", F.xxhash64("norm"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of texts with very many copies, and all others."""
    spark = rows.sparkSession
    n = 4 * partitions(spark)
    counts = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.col("n") > max(LEAST_COPIES, rows.count() // n)).select("hash", F.lit(True).alias("often"))
    tagged = rows.join(F.broadcast(often), "hash", "left")  # fewer than n rows of 9 bytes
    return tagged.where("often"), tagged.where("often IS NULL")


def _sorted(rows: DataFrame, order) -> tuple[DataFrame, Window]:
    """Rows in ranges of their text, sorted; the window sees the equal neighbours without another exchange."""
    keys = ["start", "hash", "norm"]
    placed = rows.withColumn("start", F.substring("norm", 1, START)).repartitionByRange("start", "hash")
    return placed.sortWithinPartitions(*keys, order), Window.partitionBy(*keys).orderBy(order)


def _order(keep: str):
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    return F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty. Rows that repeat both id and text are one document, given once; ``group_size`` counts
    rows. A null id is an id like any other but stays only if no other id shares its text. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    order = _order(keep)
    often, others = _split(_rows(docs, id_col, text_col, []))
    placed, same = _sorted(others.select("id", "norm", "hash"), order)
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alone = placed.select(
        "id",
        F.first("id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        F.row_number().over(same).alias("place"),
        F.lag("id").over(same).alias("before"),
        F.sha2("norm", 256).alias("text_sha256"),
    ).where((F.col("place") == 1) | ~F.col("id").eqNullSafe(F.col("before"))).drop("place", "before")

    best = F.max("id") if keep == "largest" else F.min("id")
    groups = often.groupBy("hash", "norm").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.withColumn("text_sha256", F.sha2("norm", 256))
    many = often.select("hash", "norm", "id").join(groups, ["hash", "norm"]).drop("norm", "hash").dropDuplicates(["id", "text_sha256"])
    columns = ["id", "keep_id", "group_size", "text_sha256"]
    both = alone.select(*columns).unionByName(many.select(*columns))
    return both.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all columns of ``docs``: one per group of equal texts, chosen as in ``exact_groups``."""
    order = _order(keep)
    often, others = _split(_rows(docs, id_col, text_col, docs.columns))
    placed, same = _sorted(others.select("id", "norm", "hash", "row"), order)
    alone = placed.withColumn("place", F.row_number().over(same)).where("place = 1").select("row.*")
    pick = F.max_by if keep == "largest" else F.min_by
    many = often.groupBy("hash", "norm").agg(F.coalesce(pick("row", "id"), F.any_value("row")).alias("row")).select("row.*")
    return alone.unionByName(many)

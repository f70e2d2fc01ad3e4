"""Unions, semi-joins, label maps, melting and other shape changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skyloom.slicing import hash_slices, with_ordinal


def union_tagged(dfs: Mapping[str, DataFrame] | Sequence[DataFrame], tag: str | None = None) -> DataFrame:
    """All rows of all frames, columns matched by name; ``tag`` names the source when a mapping is given."""
    if isinstance(dfs, Mapping):
        parts = [d.withColumn(tag, F.lit(k)) if tag else d for k, d in dfs.items()]
    else:
        parts = list(dfs)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_keys(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [d.select(key) for d in dfs]).distinct()


def keep_in(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*on), list(on), "left_semi")


def drop_in(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*on), list(on), "left_anti")


def keep_labels(df: DataFrame, col: str, allowed: Sequence) -> DataFrame:
    """Label arrays cut down to the allowed ones."""
    return df.withColumn(col, F.array_intersect(col, F.array(*[F.lit(a) for a in allowed])))


def melt_answers(df: DataFrame, ids: Sequence[str], numbers: Sequence[int], fields: Sequence[str], pattern: str = "recording_{i}_{field}") -> DataFrame:
    """Repeated answer column groups to one row per group."""
    group = lambda i: F.struct(F.lit(i).alias("recording"), *[F.col(pattern.format(i=i, field=f)).alias(f) for f in fields])
    return df.select(*ids, F.explode(F.array(*[group(i) for i in numbers])).alias("_a")).select(*ids, "_a.*")


def pivot_stations(df: DataFrame, stations: Sequence[str], cols: Sequence[str], key: str = "stationid", ts_col: str = "datetime") -> DataFrame:
    """Stations side by side per time, for a given station list."""
    return df.where(F.col(key).isin([str(s) for s in stations])).groupBy(ts_col).agg(
        *[F.first(F.when(F.col(key) == str(s), F.col(c)), ignorenulls=True).alias(f"{s}_{c}") for s in stations for c in cols]
    )


def join_ratings(responses: DataFrame, uids: DataFrame, classes: DataFrame) -> DataFrame:
    """Ratings with the method and file behind each id, and the file's class."""
    return responses.join(uids, "uid").join(classes, "filename")


# fixed values: the names of the label sets
CODE_MODES = ("all", "diagnostic", "subdiagnostic", "superdiagnostic", "superdiagnostic_multiclass", "form", "rhythm")


def map_codes(df: DataFrame, id_cols: Sequence[str], map_col: str, classes: DataFrame, mode: str, name: str = "target") -> DataFrame:
    """Labels of each record's codes through a class table (code, diagnostic, form, rhythm, class, subclass).

    ``superdiagnostic_multiclass`` gives the class of the likeliest code (first key on ties), the others sorted label
    arrays. Records without any known code keep an empty result.
    """
    if mode not in CODE_MODES:
        raise ValueError(f"mode is one of {CODE_MODES}")
    if mode == "all":
        return df.select(*id_cols, F.array_sort(F.map_keys(map_col)).alias(name))
    flag = "diagnostic" if "diagnostic" in mode else mode
    label = {"subdiagnostic": "subclass", "superdiagnostic": "class", "superdiagnostic_multiclass": "class"}.get(mode, "code")
    known = classes.where(F.col(flag) == 1).select("code", F.col(label).alias("_label"))
    codes = df.select(*id_cols, F.posexplode(map_col).alias("_pos", "code", "_weight"))
    hit = codes.join(known, "code").where(F.col("_label").isNotNull() | F.lit(mode == "superdiagnostic_multiclass"))
    if mode == "superdiagnostic_multiclass":
        found = hit.groupBy(*id_cols).agg(F.max_by("_label", F.struct("_weight", -F.col("_pos"))).alias(name))
        empty = F.lit("")
    else:
        found = hit.groupBy(*id_cols).agg(F.array_sort(F.collect_set("_label")).alias(name))
        empty = F.array().cast("array<string>")
    return df.select(*id_cols).join(found, list(id_cols), "left").withColumn(name, F.coalesce(name, empty))


def filter_rare_labels(df: DataFrame, id_cols: Sequence[str], labels_col: str, min_samples: int) -> DataFrame:
    """Labels seen in more than ``min_samples`` records; records left with none are dropped."""
    long = df.select(*id_cols, F.explode(labels_col).alias("_label"))
    common = long.groupBy("_label").agg(F.count("*").alias("_n")).where(F.col("_n") > min_samples)
    kept = long.join(common, "_label", "left_semi")
    again = kept.groupBy(*id_cols).agg(F.array_sort(F.collect_set("_label")).alias(labels_col))
    return df.drop(labels_col).join(again, list(id_cols))


def inverse_frequency(df: DataFrame, label: str) -> DataFrame:
    """Weight 1 / class size for every row: class sizes are counted map-side and joined back."""
    sizes = df.groupBy(label).agg(F.count("*").alias("class_count"))
    return df.join(sizes, label).withColumn("weight", 1 / F.col("class_count"))


def seeded_shuffle(df: DataFrame, id_cols: Sequence[str], seed: int) -> DataFrame:
    """Reproducible random order."""
    return df.orderBy(seeded_hash(id_cols, seed), *id_cols)


def seeded_positions(df: DataFrame, id_cols: Sequence[str], seed: int, name: str = "pos") -> DataFrame:
    """Every row with its place (from 1) in the order of ``seeded_shuffle``; places come from sliced counts of the hash,
    so nothing is sorted as a whole. Sort by them at the sink, if at all."""
    hashed = df.withColumn("_h", seeded_hash(id_cols, seed))
    return with_ordinal(hashed, [], ["_h", *id_cols], hash_slices("_h"), name).drop("_h")


def seeded_hash(id_cols: Sequence[str], seed: int):
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))


def natural_order(df: DataFrame, col: str) -> DataFrame:
    """Names ordered by the first number in them, then by name."""
    number = F.expr(rf"try_cast(nullif(regexp_extract(`{col}`, '([0-9]+)', 1), '') AS BIGINT)")
    return df.orderBy(number.asc_nulls_first(), col)


def balanced_sample(df: DataFrame, label: str, n: int, seed: int, id_cols: Sequence[str]) -> DataFrame:
    """``n`` draws with replacement, every class equally likely (weights 1 / class size).

    A draw hashes to a class and a row number inside it; draws and rows then meet in an equi-join.
    """
    rows = with_ordinal(
        df.withColumn("_h", seeded_hash(id_cols, seed)), [label], ["_h", *id_cols], hash_slices("_h"), "_no"
    ).drop("_h")
    sizes = df.groupBy(label).agg(F.count("*").alias("_size")).where(F.col(label).isNotNull())
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct(label, "_size"))).alias("_classes"))  # one entry per class
    part = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.lit(f"{seed}-{salt}"))), 1, 12), 16, 10).cast("long")
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_classes", listed.scalar())
    picked = draws.withColumn("_c", F.get("_classes", (part("class") % F.size("_classes")).cast("int"))).select(
        "draw", F.col(f"_c.{label}").alias(label), (part("row") % F.col("_c._size") + 1).alias("_no")
    )
    return picked.join(rows, [label, "_no"]).drop("_no")


def select_split_attrs(meta: DataFrame, attrs: Sequence[str], split_col: str, split) -> DataFrame:
    """Rows of one split with -1/1 attributes as 0/1."""
    return meta.where(F.col(split_col) == split).withColumns({a: F.expr(f"(`{a}` + 1) div 2").cast("int") for a in attrs})

"""Exact train / validation / test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyloom.operators.reshape import seeded_hash
from skyloom.slicing import hash_slices, with_ordinal


def _check(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError(f"split ratios must sum to 1, got {list(ratios)}")


def _size(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def _cut(n: Column, ratio: float) -> Column:
    return F.floor(n * F.lit(ratio) + 1e-9).cast("long")


def _by_hash(df: DataFrame, keys: Sequence[str], id_cols: Sequence[str], seed: int) -> DataFrame:
    hashed = df.withColumn("_h", seeded_hash(id_cols, seed))
    return with_ordinal(hashed, keys, ["_h", *id_cols], hash_slices("_h"), "_no").drop("_h")


def _name(no: Column, cuts: Sequence[tuple[str, Column]], rest: str) -> Column:
    """First name whose running border is not passed."""
    out, border = None, F.lit(0)
    for name, size in cuts:
        border = border + size
        out = F.when(no <= border, name) if out is None else out.when(no <= border, name)
    return out.otherwise(rest)


def split_random(df: DataFrame, ratios: Sequence[float], id_cols: Sequence[str], seed: int,
                 names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Seeded split with exact counts ``int(n * r)``; the last part takes the remainder."""
    _check(ratios)
    n = F.col("_n")
    numbered = _by_hash(df, [], id_cols, seed).withColumn("_n", _size(df))
    cuts = [(name, _cut(n, r)) for name, r in zip(names[:-1], ratios[:-1])]
    return numbered.withColumn("split", _name(F.col("_no"), cuts, names[-1])).drop("_no", "_n")


def split_half(df: DataFrame, id_cols: Sequence[str], seed: int, names=("tune", "measure")) -> DataFrame:
    """Two disjoint seeded halves."""
    return split_random(df, (0.5, 0.5), id_cols, seed, names)


def split_time(df: DataFrame, order: Sequence[str], ratios: Sequence[float], slices, oldest: str = "train") -> DataFrame:
    """Split along time with exact counts for (train, val, test) ratios.

    ``oldest="train"``: train, val, test from the start. ``oldest="rest"``: the newest ``int(n * test)`` rows are test,
    the next ``int(n * val)`` val, the remainder train.
    """
    _check(ratios)
    n = F.col("_n")
    numbered = with_ordinal(df, [], order, slices, "_no").withColumn("_n", _size(df))
    train, val, test = (_cut(n, r) for r in ratios)
    if oldest == "train":
        split = _name(F.col("_no"), [("train", train), ("val", val)], "test")
    else:
        split = _name(n - F.col("_no") + 1, [("test", test), ("val", val)], "train")
    return numbered.withColumn("split", split).drop("_no", "_n")


def split_borders(df: DataFrame, order: Sequence[str], slices, seq_len: int, ratios: tuple[float, float] | None = (0.7, 0.2),
                  lengths: tuple[int, int, int] | None = None) -> DataFrame:
    """Train, val and test row ranges in which val and test reach ``seq_len`` rows back into the part before.

    Borders come from (train, test) ratios or from fixed part lengths; a row may belong to two splits.
    """
    n = F.col("_n")
    numbered = with_ordinal(df, [], order, slices, "_no").withColumn("_n", _size(df))
    at = F.col("_no") - 1
    if lengths:
        a, b, c = (F.lit(x) for x in lengths)
        borders = {"train": (F.lit(0), a), "val": (a - seq_len, a + b), "test": (a + b - seq_len, a + b + c)}
    else:
        a, c = _cut(n, ratios[0]), _cut(n, ratios[1])
        borders = {"train": (F.lit(0), a), "val": (a - seq_len, n - c), "test": (n - c - seq_len, n)}
    inside = F.array_compact(F.array(*[F.when((at >= lo) & (at < hi), F.lit(k)) for k, (lo, hi) in borders.items()]))
    return numbered.withColumn("split", F.explode(inside)).drop("_no", "_n")


def split_stratified(df: DataFrame, label: str, ratios: Sequence[float], id_cols: Sequence[str], seed: int) -> DataFrame:
    """Seeded split with the same shares in every class; the last part takes each class's remainder."""
    _check(ratios)
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    numbered = _by_hash(df, [label], id_cols, seed).join(sizes, label)
    cuts = [(name, _cut(F.col("_n"), r)) for name, r in zip(("train", "val"), ratios[:-1])]
    return numbered.withColumn("split", _name(F.col("_no"), cuts, "test")).drop("_no", "_n")


def split_fold(df: DataFrame, fold_col: str, val: int = 9, test: int = 10) -> DataFrame:
    f = F.col(fold_col)
    return df.withColumn("split", F.when(f == val, "val").when(f == test, "test").otherwise("train"))


def split_ranges(df: DataFrame, order: Sequence[str], slices, train: float) -> DataFrame:
    """Leading share is train, the rest is halved into val and test."""
    n = F.col("_n")
    numbered = with_ordinal(df, [], order, slices, "_no").withColumn("_n", _size(df))
    a = _cut(n, train)
    b = F.floor((n - a) / 2).cast("long")
    return numbered.withColumn("split", _name(F.col("_no"), [("train", a), ("val", b)], "test")).drop("_no", "_n")


def split_lists(df: DataFrame, id_col: str, val_ids: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Split by membership lists; what is on no list is train, test wins over val."""
    named = lambda ids, name: ids.select(F.col(ids.columns[0]).alias(id_col)).distinct().withColumn(f"_{name}", F.lit(True))
    marked = df.join(named(val_ids, "val"), id_col, "left").join(named(test_ids, "test"), id_col, "left")
    split = F.when(F.col("_test"), "test").when(F.col("_val"), "val").otherwise("train")
    return marked.withColumn("split", split).drop("_val", "_test")


def split_train_val(df: DataFrame, val_share: float, id_cols: Sequence[str], seed: int) -> DataFrame:
    """Seeded fallback when there is no validation set."""
    return split_random(df, (1 - val_share, val_share), id_cols, seed, ("train", "val"))


def split_tail(df: DataFrame, order: Sequence[str], slices, share: float = 1 / 7) -> DataFrame:
    """Unshuffled: the last share of the rows is val."""
    n = F.col("_n")
    numbered = with_ordinal(df, [], order, slices, "_no").withColumn("_n", _size(df))
    return numbered.withColumn("split", F.when(F.col("_no") > n - _cut(n, share), "val").otherwise("train")).drop("_no", "_n")


def split_two_step(df: DataFrame, id_cols: Sequence[str], seed: int) -> DataFrame:
    """Shuffled 70 / 15 / 15: first 70 % train, then the rest in two halves."""
    n = F.col("_n")
    numbered = _by_hash(df, [], id_cols, seed).withColumn("_n", _size(df))
    a = _cut(n, 0.7)
    b = F.floor((n - a) / 2).cast("long")
    return numbered.withColumn("split", _name(F.col("_no"), [("train", a), ("val", b)], "test")).drop("_no", "_n")

"""Writers for model frames, predictions, splits and station lists."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F


def _write(df: DataFrame, path: str, fmt: str, mode: str, by: Sequence[str] = ()) -> str:
    writer = df.write.mode(mode).format(fmt)
    writer = writer.option("header", True) if fmt == "csv" else writer
    (writer.partitionBy(*by) if by else writer).save(path)
    return path


def write_model_frame(df: DataFrame, out_dir: str, station: str, prefix: str, formats: Sequence[str] = ("parquet",), mode: str = "overwrite") -> list[str]:
    """``{out_dir}/{station}_{prefix}.{format}`` for every format asked for."""
    unknown = set(formats) - {"csv", "parquet"}
    if unknown:
        raise ValueError(f"unknown formats {sorted(unknown)}")
    return [_write(df, f"{out_dir.rstrip('/')}/{station}_{prefix}.{fmt}", fmt, mode) for fmt in formats]


def write_results(df: DataFrame, out_dir: str, name: str, fmt: str = "parquet", at: datetime | None = None) -> str:
    """Predictions under a name with the time in it; an existing result is never overwritten."""
    stamp = (at or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return _write(df, f"{out_dir.rstrip('/')}/{name}_{stamp}.{fmt}", fmt, "errorifexists")


def write_splits(df: DataFrame, out_dir: str, split_col: str = "split", mode: str = "overwrite") -> str:
    """One folder per split, all written in one pass."""
    return _write(df, out_dir, "parquet", mode, [split_col])


def write_station_matches(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    flat = df.withColumns({n: F.to_json(n) for n, t in df.dtypes if t.startswith("map")})
    return _write(flat, path, "csv", mode)


def write_station_files(df: DataFrame, root: str, station_col: str, year_col: str | None = None) -> str:
    """Observation files ``{root}[/year=Y]/{station}_{n}.csv``, in the layout the readers expect.

    Tasks write side by side, so a large station simply gets more files; afterwards only names are changed.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    by = ([year_col] if year_col else []) + [station_col]
    stage = f"{root}-stage"
    _write(df, stage, "csv", "errorifexists", by)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = "/".join(f"{c}=*" for c in by)
    for n, status in enumerate(fs.globStatus(path(f"{stage}/{pattern}/part-*"))):
        folders = status.getPath().getParent()
        station = folders.getName().split("=", 1)[1]
        home = f"{root}/year={folders.getParent().getName().split('=', 1)[1]}" if year_col else root
        fs.mkdirs(path(home))
        fs.rename(status.getPath(), path(f"{home}/{station}_{n}.csv"))
    return root

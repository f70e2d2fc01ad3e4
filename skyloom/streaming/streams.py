"""Streaming forms of the periodic summary and of sliding clips."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skyloom.functions.calendar import period_seconds
from skyloom.operators.resample import OPS, check_ops
from skyloom.sources.tables import zoned_times


def read_stream(spark: SparkSession, directory: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None, **options) -> DataFrame:
    """Files of a directory as they arrive; times are made zone-aware, which a watermark needs."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return zoned_times(reader.load(directory))


def _n_unique(c: str, is_float: bool) -> Column:
    """Distinct values without nulls; the two zeros are one value, and so are all that are not a number."""
    if not is_float:
        return F.size(F.collect_set(c)).cast("long")
    numbers = F.size(F.collect_set(F.when(~F.isnan(c), F.col(c) + F.lit(0.0))))
    return (numbers + F.coalesce(F.max(F.isnan(c).cast("int")), F.lit(0))).cast("long")


def _median(c: str, is_float: bool) -> Column:
    """Exact median of the values that are numbers, from a count per distinct value."""
    return F.percentile(F.when(~F.isnan(c), F.col(c)) if is_float else F.col(c), 0.5)


def resample_stream(sdf: DataFrame, period: str, agg_map: Mapping[str, Sequence[str]], delay: str = "2 days",
                    group_col: str = "stationid", datetime_col: str = "datetime") -> DataFrame:
    """Tumbling-period summaries per group; a period is final once the watermark has passed its end.

    All operations of the batch form, with the same results. State is one small aggregate per open (group, period); with
    ``n_unique`` or ``median`` it also holds the distinct values of that period (and how often each occurs), until the
    period is final: choose periods whose distinct values fit a task.
    """
    check_ops(agg_map)
    kept = {"n_unique": _n_unique, "median": _median}
    floats = {f.name for f in sdf.schema.fields if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType)}
    made = []
    for c, ops in agg_map.items():
        for op in ops:
            value = kept[op](c, c in floats) if op in kept else OPS[op](c, datetime_col)
            made.append(value.alias(f"{c}_{op}"))
    seconds = period_seconds(period)
    start = "4 days" if seconds % 604_800 == 0 else "0 seconds"  # weeks from Monday, as in batches
    window = F.window(datetime_col, f"{seconds} seconds", f"{seconds} seconds", start).alias("_w")
    out = sdf.withWatermark(datetime_col, delay).groupBy(group_col, window).agg(*made)
    return out.select(group_col, F.col("_w.start").alias(datetime_col), *[c for c in out.columns if c not in (group_col, "_w")])


def sliding_clips(df: DataFrame, key: str, ts_col: str, length: str, stride: str, agg_map: Mapping[str, Sequence[str]],
                  delay: str | None = None) -> DataFrame:
    """Summaries of overlapping clips of fixed length and stride per subject; works on frames and on streams."""
    check_ops(agg_map)
    src = df.withWatermark(ts_col, delay) if delay else df
    made = [OPS[op](c, ts_col).alias(f"{c}_{op}") for c, ops in agg_map.items() for op in ops]
    clip = F.window(ts_col, f"{period_seconds(length)} seconds", f"{period_seconds(stride)} seconds").alias("_w")
    out = src.groupBy(key, clip).agg(*made, F.count("*").alias("n"))
    return out.select(key, F.col("_w.start").alias("clip_start"), F.col("_w.end").alias("clip_end"), *[c for c in out.columns if c not in (key, "_w")])


def run_to_end(sdf: DataFrame, out_dir: str, checkpoint_dir: str, mode: str = "append") -> DataFrame:
    """Process what is there, stop, and give the written rows back as a frame."""
    sdf.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start(out_dir).awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(out_dir)

"""What the operators of this subpackage share: reading tables, text normal forms, stored intermediates."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyloom.session import cut_lineage, scratch_path


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = "4m"  # bytes of a batch of rows sent to a Python worker; counted in rows alone, long texts fill its memory


def bounded_batches(spark: SparkSession) -> None:
    """Limit the bytes of the batches that go to Python workers from here on."""
    if spark.conf.get(_BATCH_BYTES, None) != BATCH:
        spark.conf.set(_BATCH_BYTES, BATCH)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``, which folds every script."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back."""
    return cut_lineage(df)


def stored_small(df: DataFrame) -> DataFrame:
    """``stored`` for columns of text: compressed harder."""
    spark = df.sparkSession
    path = scratch_path(spark, "texts")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

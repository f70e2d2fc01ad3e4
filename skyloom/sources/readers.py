"""Readers for station metadata, observation files, tables, relative series and text lines."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skyloom.functions.calendar import decode_relative

logger = logging.getLogger(__name__)

STATION_FILE = "^([0-9]+)_.*[.]csv$"


def _file_order() -> list:
    """Columns that sort the rows of files as they stand in them."""
    return [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")]


def load_stations(spark: SparkSession, path: str, colmap: Mapping[str, str] | None = None) -> DataFrame:
    """(stid, latitude, longitude, extra_data): missing columns become null, the rest a map without nulls, first
    row per station wins."""
    names = {"stid": "stid", "latitude": "latitude", "longitude": "longitude", **(colmap or {})}
    raw = spark.read.option("header", True).csv(path)
    made = []
    for std, kind in (("stid", "string"), ("latitude", "double"), ("longitude", "double")):
        if names[std] in raw.columns:
            made.append(F.col(f"`{names[std]}`").try_cast(kind).alias(std))
        else:
            logger.warning("station column %r not found in %s; filled with null", names[std], path)
            made.append(F.lit(None).cast(kind).alias(std))
    extra = [c for c in raw.columns if c not in names.values()]
    pairs = [x for c in extra for x in (F.lit(c), F.col(f"`{c}`"))]
    packed = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    made.append(F.map_filter(packed, lambda _, v: v.isNotNull()).alias("extra_data"))
    rows = raw.select(*made, F.struct(*_file_order()).alias("_at"))
    # min_by keeps one row per station and partition before the shuffle
    whole = F.struct("latitude", "longitude", "extra_data")
    return rows.groupBy("stid").agg(F.min_by(whole, "_at").alias("_r")).select("stid", "_r.latitude", "_r.longitude", "_r.extra_data")


def _glob(ids: Sequence[str] | None) -> str:
    return "[0-9]*_*.csv" if not ids else "{" + ",".join(f"{i}_*" for i in ids) + "}.csv"


def list_observation_files(spark: SparkSession, root: str, ids: Sequence[str] | None = None) -> DataFrame:
    """(stationid, path) of files named ``{digits}_….csv`` anywhere below ``root``; file contents are not read."""
    ids = sorted({str(i) for i in ids}) if ids is not None else None
    if ids == []:
        return spark.createDataFrame([], "stationid string, path string")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(ids)).load(root)
    )
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select(F.regexp_extract(name, STATION_FILE, 1).alias("stationid"), "path").where("stationid != ''")
    return listed.where(F.col("stationid").isin(ids)) if ids is not None else listed


def missing_stations(files: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Ids without any file."""
    wanted = files.sparkSession.createDataFrame([(str(i),) for i in sorted(set(ids))], "stationid string")
    return wanted.join(files, "stationid", "left_anti")


def observation_schema(spark: SparkSession, root: str, numeric: Sequence[str], ids: Sequence[str] | None = None) -> T.StructType:
    """Columns of the observation files from their header: the named ones numbers, the rest text."""
    head = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", _glob(ids)).csv(root)
    return T.StructType([T.StructField(c, T.DoubleType() if c in numeric else T.StringType()) for c in head.columns])


def _observation_lines(spark: SparkSession, root: str, listed: list[str] | None) -> DataFrame:
    """Lines of the observation files, headers too, with their file, its block and station."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _glob(listed)).text(root).select(
        F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.regexp_extract(F.col("_metadata.file_name"), STATION_FILE, 1).alias("stationid"),
    ).where("stationid != ''")


def _parsed(spark: SparkSession, root: str, schema: T.StructType, ids) -> DataFrame:
    """Lines below the headers with their cells.

    Headers are read first, on their own. Files of one layout, the usual case, are then parsed where they are read; only
    files of several layouts are joined with their headers.
    """
    listed = None if ids is None or isinstance(ids, DataFrame) else sorted({str(i) for i in ids})
    lines = _observation_lines(spark, root, listed)
    # the first line of a file is the first row of its first block
    heads = lines.where("_block = 0").withColumn("_row", F.monotonically_increasing_id()).groupBy("_path").agg(F.min_by("_line", "_row").alias("_head"))
    layouts = [r["_head"] for r in heads.select("_head").distinct().collect()]
    lines = lines.withColumn("_head", F.lit(layouts[0])) if len(layouts) == 1 else lines.join(heads, "_path")
    lines = lines.where(F.col("_line") != F.col("_head"))
    if listed is not None:
        lines = lines.where(F.col("stationid").isin(listed))
    elif isinstance(ids, DataFrame):
        lines = lines.join(ids.select("stationid").distinct(), "stationid", "left_semi")
    kinds = {f.name: f.dataType for f in schema.fields}
    empty = F.lit(None).cast(T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]))
    found = empty
    for head in sorted(layouts):
        names = [n.strip().strip('"') for n in head.lstrip("\ufeff").split(",")]
        layout = T.StructType([T.StructField(f"c{i}", kinds.get(n, T.StringType())) for i, n in enumerate(names)] + [T.StructField("_bad", T.StringType())])
        cells = F.from_csv("_line", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in layout.fields), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        place = {n: f"c{i}" for i, n in enumerate(names)}
        by_name = F.struct(*[
            (cells[place[f.name]] if f.name in place else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
        ], cells["_bad"].alias("_bad"))
        found = F.when(F.col("_head") == head, by_name).otherwise(found)
    return lines.select("stationid", F.col("_path").alias("path"), F.col("_line").alias("line"), found.alias("cells"))


def read_observations(spark: SparkSession, root: str, schema: T.StructType, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """All observation files in one scan, ``stationid`` taken from the file name.

    Columns go by the names in each file's own header, whatever their order; those a file lacks are null. A list of ids
    picks the files while listing them; a frame of ids is semi-joined. Unreadable cells become null; the records that
    have them, or too few or many cells, are listed by ``rejected_records``.
    """
    return _parsed(spark, root, schema, ids).select("cells.*", "stationid").drop("_bad")


def rejected_records(spark: SparkSession, root: str, schema: T.StructType, ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """(stationid, path, line) of the records that do not fit the layout of their file."""
    return _parsed(spark, root, schema, ids).where("cells._bad IS NOT NULL").select("stationid", "path", "line")


def ensure_datetime(df: DataFrame, date_col: str = "date", time_col: str = "hour", datetime_col: str = "datetime",
                    fractional_hours: bool = False) -> DataFrame:
    """``datetime_col`` as a timestamp: the column itself if present, else date plus hours; bad values become null."""
    if datetime_col in df.columns:
        if isinstance(df.schema[datetime_col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return df.withColumn(datetime_col, F.col(datetime_col).cast("timestamp"))
        return df.withColumn(datetime_col, F.col(datetime_col).try_cast("timestamp"))
    if date_col not in df.columns or time_col not in df.columns:
        raise ValueError(f"no time source: need {datetime_col!r}, or {date_col!r} and {time_col!r}")
    day = F.to_date(F.col(date_col).try_cast("timestamp")) if isinstance(df.schema[date_col].dataType, T.StringType) else F.to_date(date_col)
    hours = F.col(time_col).try_cast("double")
    hours = hours if fractional_hours else F.floor(hours)
    micros = F.unix_micros(day.cast("timestamp")) + F.round(hours * 3_600_000_000).cast("long")
    return df.withColumn(datetime_col, F.timestamp_micros(micros))


def load_tabular(spark: SparkSession, path: str, target: str, features: Sequence[str] | None = None,
                 modeltype: str = "classification", fmt: str | None = None) -> tuple[DataFrame, int]:
    """(frame with features and target, number of outputs): nulls become 0, untyped columns numbers."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith("parquet") else "csv")
    reader = spark.read.format(fmt)
    df = (reader.option("header", True).option("inferSchema", True) if fmt == "csv" else reader).load(path)
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    df = df.withColumns({c: F.col(c).cast("double") for c in void}) if void else df
    cols = list(features) if features is not None else [c for c in df.columns if c != target]
    df = df.select(*cols, target).fillna(0)
    n_out = df.agg(F.count_distinct(target)).head()[0] if modeltype == "classification" else 1
    return df, n_out


def read_station_years(spark: SparkSession, root: str, schema: T.StructType, station_ids: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Chosen stations out of a tree ``year=*/{station}….csv``; years prune folders, ids prune files."""
    glob = "{" + ",".join(f"{s}[._]*" for s in station_ids) + "}"
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])).option("header", True)
    rows = reader.option("pathGlobFilter", glob).csv(root)
    name = F.regexp_extract(F.col("_metadata.file_name"), "^([^._]+)", 1)
    return rows.withColumn("station", name).where(F.col("year").isin(list(years)) & F.col("station").isin([str(s) for s in station_ids]))


def drop_blank_records(df: DataFrame, key_col: str) -> DataFrame:
    """Rows with a non-blank key; fully blank lines go with them."""
    return df.where(F.trim(F.coalesce(F.col(key_col), F.lit(""))) != "")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t", header: bool = False, **options) -> DataFrame:
    return spark.read.schema(schema).options(header=header, sep=sep, **options).csv(path)


def read_relative_series(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv",
                         name_col: str = "var_name", ref_col: str = "ref_date") -> DataFrame:
    """Series named by days and hours before a reference date that stands in one row only."""
    rows = spark.read.schema(schema).options(**({"header": True} if fmt == "csv" else {})).format(fmt).load(path)
    ref = rows.where(F.col(ref_col).isNotNull()).agg(F.max(F.col(ref_col).cast("timestamp")))
    return decode_relative(rows.withColumn("_ref", ref.scalar()), name_col, "_ref").drop("_ref", ref_col)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and place."""
    return spark.read.text(path).select(F.col("value").alias("line"), *_file_order())

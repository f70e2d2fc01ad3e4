"""Parquet tables as frames with zone-aware times, and the station-shaped views built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skyloom.session import prepare


def zoned_times(df: DataFrame) -> DataFrame:
    """TIMESTAMP_NTZ columns as TIMESTAMP (session zone is UTC)."""
    todo = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in todo}) if todo else df


def plain_times(df: DataFrame) -> DataFrame:
    """TIMESTAMP columns as TIMESTAMP_NTZ, for results compared with engines without zones."""
    todo = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in todo}) if todo else df


def folds(vector: str, n: int) -> Column:
    """``n`` sums over a whole vector: sum ``c`` takes every entry whose place (from 0) leaves ``c`` over ``n``."""
    part = lambda c: F.filter(vector, lambda x, i: i % n == c)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.aggregate(part(c), F.lit(0.0), lambda acc, x: acc + x.cast("double")))


class Tables:
    """``t.events`` reads ``{root}/events.parquet``; ``t.obs`` and friends are the derived views."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return zoned_times(self.spark.read.parquet(f"{self.root}/{name}.parquet"))

    @property
    def obs(self) -> DataFrame:
        return self.events.select(
            (F.col("user_id") % 5).cast("string").alias("stationid"),
            F.col("ts").alias("datetime"),
            F.col("value").alias("precip"),
            "event_id",
        )

    @property
    def obsd(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_suppkey").cast("string").alias("stationid"),
            F.col("l_shipdate").alias("datetime"),
            F.col("l_quantity").alias("precip"),
            F.col("l_discount").alias("temp"),
        )

    @property
    def obsh(self) -> DataFrame:
        """Hourly means; readings whose id is a multiple of 11 count as missing."""
        return (
            self.obs.withColumn("precip", F.when(F.col("event_id") % 11 != 0, F.col("precip")))
            .groupBy("stationid", F.date_trunc("hour", "datetime").alias("datetime"))
            .agg(F.avg("precip").alias("precip"), F.count("*").alias("n"))
        )

    @property
    def stations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.supplier.select(
            k.cast("string").alias("stid"),
            (F.lit(25.0) + ((k * 7) % 2500) / F.lit(100.0)).alias("latitude"),
            (F.lit(-125.0) + ((k * 13) % 5800) / F.lit(100.0)).alias("longitude"),
            "s_name",
            "s_nationkey",
        )

    @property
    def rawrec(self) -> DataFrame:
        """Fixed-width record fields made from event values."""
        code = F.element_at(F.array(*[F.lit(c) for c in "0123459"]), (F.col("event_id") % 7 + 1).cast("int"))
        tenth = F.floor(F.col("value") * 10).cast("long")
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        comma = lambda *parts: F.concat_ws(",", *parts)
        return self.events.select(
            (F.col("user_id") % 5).cast("string").alias("STATION"),
            F.col("ts").alias("DATE"),
            "event_id",
            F.when(F.col("event_id") % 13 == 0, F.lit("")).otherwise(
                comma(F.lit("01"), pad(tenth % 10000, 4), F.lit("9"), code)
            ).alias("AA1"),
            F.when(F.col("event_id") % 3 == 0, comma(F.lit("06"), pad((tenth * 3) % 10000, 4), F.lit("2"), code)).alias("AA2"),
            *[
                F.when(
                    F.col("event_id") % 3 == rest, comma(F.lit("024"), F.lit(letter), pad(tenth % 101, 3), F.lit("D"), code)
                ).alias(name)
                for name, letter, rest in (("RH1", "X", 2), ("RH2", "N", 1), ("RH3", "M", 0))
            ],
            comma(
                F.when(F.col("event_id") % 29 == 0, F.lit("+9999")).otherwise(
                    F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("+")).otherwise(F.lit("-")), pad(tenth % 500, 4))
                ), code,
            ).alias("TMP"),
            comma(pad(F.lit(10000) + tenth % 500, 5), code).alias("SLP"),
            comma(pad(tenth % 360, 3), code, F.lit("N"), pad(tenth % 300, 4), code).alias("WND"),
            comma(pad(tenth % 22000, 5), code, F.lit("M"), F.lit("N")).alias("CIG"),
        )

    @property
    def pred(self) -> DataFrame:
        """True and predicted class of every line item, with a probability."""
        q = F.col("l_quantity")
        cls = lambda c: F.when(c < 1, 0).when(c < 10, 1).when(c < 25, 2).when(c < 40, 3).otherwise(4)
        return self.lineitem.select(
            F.col("l_suppkey").cast("string").alias("stationid"),
            cls(q).alias("actual"),
            cls(q + F.col("l_linenumber") - 4).alias("predicted"),
            q.alias("measured"),
            (q * 0.9 + F.col("l_linenumber")).alias("estimate"),
            (F.least(F.lit(0.99), q / 60 + F.col("l_linenumber") / 50.0)).alias("prob"),
            F.md5(
                F.concat_ws(
                    "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    F.floor(q), F.floor(F.col("l_extendedprice") * 100 + 0.5),
                    "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM-dd"),
                )
            ).alias("id"),
        )

    @property
    def probs(self) -> DataFrame:
        """Scores of ten classes, folded from all embedding entries."""
        return self.embeddings.select("vec_id", "label", folds("embedding", 10).alias("scores"))

    @property
    def seq(self) -> DataFrame:
        return self.events.select("user_id", "ts", "event_id", "value", "event_type")

    @property
    def rate(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("worker"),
            F.col("event_type").alias("method"),
            (F.col("event_id") % 50).alias("item"),
            (F.floor("value").cast("long") % 5 + 1).alias("quality"),
            "event_id",
        )


# --- the same views as SQL text ------------------------------------------------------------------------------------
OBS = """obs AS (SELECT CAST(user_id % 5 AS VARCHAR) AS stationid, ts AS datetime, value AS precip, event_id FROM events)"""
OBSD = """obsd AS (SELECT CAST(l_suppkey AS VARCHAR) AS stationid, l_shipdate AS datetime, l_quantity AS precip,
  l_discount AS temp FROM lineitem)"""
OBSH = f"""{OBS}, obsh AS (SELECT stationid, date_trunc('hour', datetime) AS datetime,
  avg(CASE WHEN event_id % 11 <> 0 THEN precip END) AS precip, count(*) AS n FROM obs GROUP BY 1, 2)"""
STN = """stations AS (SELECT CAST(s_suppkey AS VARCHAR) AS stid, CAST(25.0 + ((s_suppkey*7) % 2500)/100.0 AS DOUBLE) AS latitude,
  CAST(-125.0 + ((s_suppkey*13) % 5800)/100.0 AS DOUBLE) AS longitude, s_name, s_nationkey FROM supplier)"""
_CODE = "substr('0123459', CAST(event_id % 7 AS INTEGER) + 1, 1)"
_T = "CAST(floor(value * 10) AS BIGINT)"
RAWREC = f"""rawrec AS (SELECT CAST(user_id % 5 AS VARCHAR) AS STATION, ts AS DATE, event_id,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE '01,' || lpad(CAST({_T} % 10000 AS VARCHAR), 4, '0') || ',9,' || {_CODE} END AS AA1,
  CASE WHEN event_id % 3 = 0 THEN '06,' || lpad(CAST(({_T} * 3) % 10000 AS VARCHAR), 4, '0') || ',2,' || {_CODE} END AS AA2,
  {', '.join(f"CASE WHEN event_id % 3 = {r} THEN '024,{l},' || lpad(CAST({_T} % 101 AS VARCHAR), 3, '0') || ',D,' || {_CODE} END AS {n}"
             for n, l, r in (('RH1', 'X', 2), ('RH2', 'N', 1), ('RH3', 'M', 0)))},
  CASE WHEN event_id % 29 = 0 THEN '+9999' ELSE (CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END)
    || lpad(CAST({_T} % 500 AS VARCHAR), 4, '0') END || ',' || {_CODE} AS TMP,
  lpad(CAST(10000 + {_T} % 500 AS VARCHAR), 5, '0') || ',' || {_CODE} AS SLP,
  lpad(CAST({_T} % 360 AS VARCHAR), 3, '0') || ',' || {_CODE} || ',N,' || lpad(CAST({_T} % 300 AS VARCHAR), 4, '0') || ',' || {_CODE} AS WND,
  lpad(CAST({_T} % 22000 AS VARCHAR), 5, '0') || ',' || {_CODE} || ',M,N' AS CIG
  FROM events)"""
_CLS = "CASE WHEN {0} < 1 THEN 0 WHEN {0} < 10 THEN 1 WHEN {0} < 25 THEN 2 WHEN {0} < 40 THEN 3 ELSE 4 END"
PRED = f"""pred AS (SELECT CAST(l_suppkey AS VARCHAR) AS stationid, {_CLS.format('l_quantity')} AS actual,
  {_CLS.format('(l_quantity + l_linenumber - 4)')} AS predicted, l_quantity AS measured,
  l_quantity * CAST(0.9 AS DOUBLE) + l_linenumber AS estimate,
  least(CAST(0.99 AS DOUBLE), l_quantity / 60 + l_linenumber / CAST(50.0 AS DOUBLE)) AS prob,
  md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
    CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR), CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS VARCHAR),
    l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS id FROM lineitem)"""
def folds_sql(vector: str, n: int) -> str:
    return f"[list_sum([CAST({vector}[k] AS DOUBLE) FOR k IN range(c, len({vector}) + 1, {n})]) FOR c IN range(1, {n + 1})]"


PROBS = f"""probs AS (SELECT vec_id, label, {folds_sql('embedding', 10)} AS scores FROM embeddings)"""
RATE = """rate AS (SELECT user_id AS worker, event_type AS method, event_id % 50 AS item,
  CAST(floor(value) AS BIGINT) % 5 + 1 AS quality, event_id FROM events)"""

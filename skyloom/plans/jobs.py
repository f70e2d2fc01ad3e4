"""Whole jobs: from files or observation frames to model-ready frames."""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.functions.arrays import parse_probs
from skyloom.functions.binning import bin_col, cut_and_label
from skyloom.functions.calendar import encode_relative
from skyloom.operators import features as fe
from skyloom.operators import records as rc
from skyloom.operators import resample as rs
from skyloom.operators import splits as sp
from skyloom.operators import stations as st
from skyloom.operators.models import score
from skyloom.operators.reshape import union_tagged
from skyloom.session import cut_lineage, prepare
from skyloom.slicing import own_rows, row_frames, time_slices
from skyloom.sources import readers
from skyloom.sources.sinks import write_results

logger = logging.getLogger(__name__)


# --- model frame from station files --------------------------------------------------------------------------------
@dataclass
class StationRules:
    """Where stations are listed, and which of them take part: a radius around the target, and others by id."""

    table: str = "data/stations.csv"
    id_col: str = "stid"
    latitude_col: str = "latitude"
    longitude_col: str = "longitude"
    radius_miles: float = 0.0
    side: str | None = None
    nearest_only: int | None = None
    also: list[str] = field(default_factory=list)


@dataclass
class SeriesRules:
    """Where readings are, how their time is written, and the periodic summary made of them."""

    folder: str = "data"
    times: dict[str, str] = field(default_factory=lambda: {"date_col": "date", "time_col": "hour", "datetime_col": "datetime"})
    summary: dict[str, list[str]] | None = None
    period: str = "1d"


@dataclass
class FeatureRules:
    """Lags, the span of years, the bins of the target, and rolling features of neighbours."""

    lag_days: float = 7
    last_years: float | None = None
    variables: list[str] | None = None
    bin_edges: list[float] = field(default_factory=lambda: [-9999, 1, 5, 20, 99999])
    bin_names: list[int] = field(default_factory=lambda: [0, 1, 2, 3])
    without_keys: bool = True
    neighbours: bool = False
    neighbour_summary: dict[str, list[str]] | None = None
    windows: list[int] | None = None
    target_too: bool = False
    parts: str = "both"


@dataclass
class OutputRules:
    folder: str = "output"
    name: str = "pipeline"
    formats: list[str] = field(default_factory=lambda: ["csv", "parquet"])


@dataclass
class FrameConfig:
    """Settings of ``build_model_frame``."""

    stations: StationRules = field(default_factory=StationRules)
    series: SeriesRules = field(default_factory=SeriesRules)
    features: FeatureRules = field(default_factory=FeatureRules)
    output: OutputRules = field(default_factory=OutputRules)


# fixed values: the keys of a settings file and the settings they stand for
SETTING_KEYS = {
    "stations_csv": ("stations", "table"),
    "station_id_col": ("stations", "id_col"),
    "latitude_col": ("stations", "latitude_col"),
    "longitude_col": ("stations", "longitude_col"),
    "n_miles": ("stations", "radius_miles"),
    "direction": ("stations", "side"),
    "max_stations": ("stations", "nearest_only"),
    "extra_station_ids": ("stations", "also"),
    "weather_dir": ("series", "folder"),
    "time_args": ("series", "times"),
    "agg_map": ("series", "summary"),
    "period_freq": ("series", "period"),
    "lookback_days": ("features", "lag_days"),
    "years_back": ("features", "last_years"),
    "indep_vars": ("features", "variables"),
    "bins": ("features", "bin_edges"),
    "labels": ("features", "bin_names"),
    "drop_date_stationid": ("features", "without_keys"),
    "calculate_aux_features": ("features", "neighbours"),
    "aux_agg_map": ("features", "neighbour_summary"),
    "aux_rolling_windows": ("features", "windows"),
    "aux_resample_apply_to_primary": ("features", "target_too"),
    "aux_output_mode": ("features", "parts"),
    "output_dir": ("output", "folder"),
    "output_prefix": ("output", "name"),
    "output_formats": ("output", "formats"),
}
IGNORED_KEYS = ("engine", "chunk_size", "n_workers")  # fixed values: accepted in a settings file, without effect here


def frame_config(given: Mapping[str, object]) -> FrameConfig:
    """Settings from the keys of a settings file; an unknown key is an error."""
    unknown = set(given) - set(SETTING_KEYS) - set(IGNORED_KEYS)
    if unknown:
        raise TypeError(f"unknown settings: {sorted(unknown)}")
    config = FrameConfig()
    for key, value in given.items():
        if key in SETTING_KEYS:
            group, name = SETTING_KEYS[key]
            setattr(getattr(config, group), name, value)
    return config


def load_config(path: str) -> FrameConfig:
    """Settings from a JSON file."""
    with open(path, encoding="utf-8") as f:
        return frame_config(json.load(f))


def build_model_frame(
    spark: SparkSession, config: FrameConfig, station_id: str | None = None, latitude: float | None = None,
    longitude: float | None = None, target_var: str = "precip_depth_sum_mm_sum",
) -> DataFrame | None:
    """Stations -> files -> periodic summary -> (auxiliary rolling features) -> lags, target and bins.

    Only the short station list is brought to the driver. None if no station or no file matches.
    """
    prepare(spark)
    picked, rules, made = config.stations, config.series, config.features
    stations = readers.load_stations(spark, picked.table, {"stid": picked.id_col, "latitude": picked.latitude_col, "longitude": picked.longitude_col})
    near = st.find_nearest(stations, station_id, latitude, longitude, picked.radius_miles, picked.nearest_only, picked.side)
    matches = [r[0] for r in near.select("stid").collect()]
    if not matches:
        logger.warning("no station matches")
        return None
    wanted = list(dict.fromkeys([*matches, *picked.also]))
    files = readers.list_observation_files(spark, rules.folder, wanted)
    have = {r[0] for r in files.select("stationid").distinct().collect()}
    if set(wanted) - have:
        logger.warning("stations without files: %s", sorted(set(wanted) - have))
    ids = [s for s in wanted if s in have]
    if not ids:
        return None
    others = [s for s in ids if s != station_id]
    summary = rules.summary or {target_var.rsplit("_", 1)[0]: [target_var.rsplit("_", 1)[1]]}
    schema = readers.observation_schema(spark, rules.folder, list(summary), ids)
    raw = readers.ensure_datetime(readers.read_observations(spark, rules.folder, schema, ids), **rules.times)
    ts_col = rules.times.get("datetime_col", "datetime")
    # lags, features of neighbours and the cutoff all read this: store it once
    series = cut_lineage(rs.resample(raw, rules.period, summary, datetime_col=ts_col))
    beside = []
    if made.neighbours and made.neighbour_summary:
        rolled = fe.rolling_history(series, made.neighbour_summary, made.windows or [], others, ts_col=ts_col)
        if made.target_too and station_id is not None:
            own = fe.rolling_history(series, made.neighbour_summary, made.windows or [], [station_id], ts_col=ts_col)
            rolled = fe.merge_target_neighbour(own, rolled, ts_col)
        if len(rolled.columns) > 1:
            beside = [rolled.withColumn("stationid", F.lit(station_id).cast("string"))]
    return fe.dependent_frame(
        series, target_var, made.lag_days, rules.period, stations=ids, indep_vars=made.variables or [], aux_stations=others, aux_dfs=beside,
        aux_output_mode=made.parts, years_back=made.last_years, drop_date_stationid=made.without_keys, bins=made.bin_edges, labels=made.bin_names,
        ts_col=ts_col,
    )


# --- raw records ---------------------------------------------------------------------------------------------------
MEASURES = {"precip": ("PR", "precip_depth_sum_mm"), "temperature": ("AT", "air_temp_degrees_cels"), "humidity": ("RH", "Rel_Hum_pct")}


def clean_records(raw: DataFrame, as_of, metrics: Sequence[str], ids: Sequence[str] = ("STATION", "DATE"), states: Sequence[str] = ()) -> DataFrame:
    """Wide raw records of any number of stations -> (STATION, measure, var_name, value, ref_date).

    All stations go through one plan; ``states`` keeps US stations of those states (needs NAME).
    """
    if states:
        raw = rc.add_country_state(raw).where(F.col("US_State").isin(*states))
    long = rc.melt_metrics(raw, list(ids), list(metrics))
    parts = {}
    for metric, (prefix, col) in MEASURES.items():
        clean = rc.clean_station(long, metric).withColumn("_d", F.col("Date_YYYYMMDD"))
        named = encode_relative(clean, prefix, as_of, "_d", "HOUR")
        parts[metric] = named.select("STATION", "var_name", F.col(col).alias("value"))
    return union_tagged(parts, "measure").withColumn("ref_date", F.lit(as_of).cast("date"))


# --- regional frames -----------------------------------------------------------------------------------------------
# fixed values: edges and names of the target bins
RAIN_BINS = ([-math.inf, 0.1, 0.5, 1, 2, 3, 4, 5, math.inf], [0.0, 0.1, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0])
DAY_BINS = ([-math.inf, 1, 5, 20, math.inf], [0, 1, 2, 3])


def _split_each(df: DataFrame, key: str, id_cols: Sequence[str], ratios: Sequence[float], seed: int) -> DataFrame:
    """Exact seeded split per station. Sizes, places and rows read the frame: it is stored first, not computed thrice."""
    return sp.split_stratified(cut_lineage(df), key, ratios, id_cols, seed)


def regional_frame(
    series: DataFrame, pairs: DataFrame, value: str, n_lags: int, max_neighbours: int | None = None, ratios=(0.7, 0.15, 0.15), seed: int = 0,
    key: str = "stationid", ts_col: str = "datetime", slices=None,
) -> DataFrame:
    """For every target station: regional mean and rain counts of the periods before, rain-only rows, bins and splits.

    ``pairs`` is (tgt_stid, feat_stid, distance), the target included; ``max_neighbours`` keeps only the nearest ones.
    """
    known = pairs.join(series.select(F.col(key).alias("feat_stid")).distinct(), "feat_stid", "left_semi")
    near = known if max_neighbours is None else st.cap_per_target(known, "tgt_stid", ["distance", "feat_stid"], max_neighbours)
    near = near.select("tgt_stid", "feat_stid")
    around = near.join(series.select(F.col(key).alias("feat_stid"), ts_col, value), "feat_stid")
    v, own = F.col(value), F.col("feat_stid") == F.col("tgt_stid")
    area = around.groupBy("tgt_stid", ts_col).agg(
        F.avg(v).alias("avg"), F.count_if(v >= 0).alias("cnt_ge0"), F.count_if(v > 0).alias("cnt_gt0"),
        F.max(F.when(own, v)).alias("target"), F.max(own).alias("_has"),
    ).where("_has").drop("_has")
    area = cut_lineage(area)
    frame, w = row_frames(area, ["tgt_stid"], [ts_col], slices or time_slices(ts_col, "month"), before=n_lags)
    lags = own_rows(frame.withColumns({f"{c}_lags": fe._lags(c, w, n_lags) for c in ("avg", "cnt_ge0", "cnt_gt0")}))
    full = lags.where(F.size("avg_lags") == n_lags).withColumns({"month": F.month(ts_col), "hour": F.hour(ts_col)})
    wet = fe.keep_finite(fe.keep_wet_windows(full, "avg_lags"), "target")
    binned = wet.withColumn("tgt_bin", bin_col("target", *RAIN_BINS, closed="right", outside="null"))
    out = binned.select("tgt_stid", ts_col, "tgt_bin", "month", "hour", "avg_lags", "cnt_ge0_lags", "cnt_gt0_lags")
    return _split_each(out, "tgt_stid", ["tgt_stid", ts_col], ratios, seed)


def day_summary_frame(
    series: DataFrame, value: str, metrics: Sequence[str] = (), gap_days: int = 3, history_days: int = 30, ratios=(0.7, 0.15, 0.15),
    seed: int = 0, direction: str = "forward", key: str = "stationid", ts_col: str = "datetime", slices=None,
) -> DataFrame:
    """24-hour sums and means per station, the target ``gap_days`` ahead of ``history_days`` of them, bins and splits."""
    aggs = {"precip_sum": (value, "sum"), "precip_mean": (value, "mean"), **{f"{m}_mean": (m, "mean") for m in metrics}}
    day = fe.rolling_time(series.select(key, ts_col, value, *metrics), [key], ts_col, aggs, 24, 6, direction)
    gap, n = gap_days * 24, history_days * 24
    frame, w = row_frames(day, [key], [ts_col], slices or time_slices(ts_col, "month"), before=gap + n)
    rows = F.reverse(F.collect_list(F.struct(*aggs)).over(w.rowsBetween(-(gap + n - 1), -gap)))
    full = own_rows(frame.withColumns({"history": rows, "month": F.month(ts_col), "hour": F.hour(ts_col)})).where(F.size("history") == n)
    kept = fe.keep_finite(full, "precip_sum").withColumn("tgt_bin", bin_col("precip_sum", *DAY_BINS, closed="right", outside="null"))
    out = kept.select(key, ts_col, "tgt_bin", "month", "hour", "history")
    return _split_each(out, key, [key, ts_col], ratios, seed)


def merged_series_frame(
    sources: Sequence[DataFrame], key: str, freq: str, aggs: Mapping[str, str], target: str, n_lags: int, bins, labels,
    ratios=(0.7, 0.1, 0.2), slices=None,
) -> DataFrame:
    """Sources of one station aligned on time, summarised per period, lagged, labelled and split, oldest rows first."""
    merged = rs.align_sources(sources, key)
    series = rs.aggregate_time(merged, key, freq, list(aggs), list(aggs.values()))
    cut = slices or time_slices(key, "year")
    lagged = fe.add_lags(series, key, target, n_lags, cut)
    return sp.split_time(cut_lineage(cut_and_label(lagged, target, bins, labels)), [key], ratios, cut)


def regional_errors(series: DataFrame, pairs: DataFrame, n_lags: int, key: str = "stationid", ts_col: str = "datetime") -> DataFrame:
    """(tgt_stid, n, reason) of the targets that ``regional_frame`` cannot serve, instead of leaving them out in silence."""
    counts = series.groupBy(F.col(key).alias("tgt_stid")).agg(F.count_distinct(ts_col).alias("n"))
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n == 0, "no readings").when(n <= n_lags, "too few periods")
    return pairs.select("tgt_stid").distinct().join(counts, "tgt_stid", "left").select("tgt_stid", n.alias("n"), reason.alias("reason")).where("reason IS NOT NULL")


def day_summary_errors(series: DataFrame, gap_days: int = 3, history_days: int = 30, key: str = "stationid", ts_col: str = "datetime") -> DataFrame:
    """(station, n, reason) of the stations with too few rows for ``day_summary_frame``."""
    counts = series.groupBy(key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") < (gap_days + history_days) * 24).withColumn("reason", F.lit("too few periods"))


def score_table(
    spark: SparkSession, path: str, scorer, id_cols: Sequence[str], features: Sequence[str], target: str, out_dir: str, name: str,
    modeltype: str = "classification", at=None,
) -> str:
    """Read a table, score it and write the result under a name with the time in it.

    Ids, features and the target stay in the row of their prediction. Gives the path of the result.
    """
    table, _ = readers.load_tabular(spark, path, target, [*id_cols, *features], modeltype)
    return write_results(score(table, scorer, features, modeltype), out_dir, name, at=at)


def combine_predictions(parts: Mapping[str, DataFrame], probs_col: str, classes: Sequence) -> DataFrame:
    """Predictions of all parts in one frame, tagged, with one ``pval_k`` column per class."""
    both = union_tagged(parts, "part").withColumn("_p", parse_probs(probs_col))
    return both.withColumns({f"pval_{c}": F.col("_p")[str(c)] for c in classes}).drop("_p", probs_col)


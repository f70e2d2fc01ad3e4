"""Command line: build the model frame of a station or point and write it."""

from __future__ import annotations

import argparse
import logging
import time
from pathlib import Path

from pyspark.sql import SparkSession

from skyloom.plans.jobs import build_model_frame, load_config
from skyloom.session import SETTINGS, remove_scratch, scratch_mark
from skyloom.sources.sinks import write_model_frame

logger = logging.getLogger("skyloom")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skyloom", description="Build a model frame from station files")
    parser.add_argument("--config", default="frame_config.json", help="JSON settings")
    parser.add_argument("--station-id", help="target station")
    parser.add_argument("--lat", type=float, help="latitude of a target point")
    parser.add_argument("--lon", type=float, help="longitude of a target point")
    parser.add_argument("--target-var", default="precip_depth_sum_mm_sum", help="column to predict")
    args = parser.parse_args(argv)
    if not Path(args.config).exists():
        raise FileNotFoundError(f"no settings at {args.config}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    builder = SparkSession.builder.appName("skyloom")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark, config, started = builder.getOrCreate(), load_config(args.config), time.perf_counter()
    mark = scratch_mark()
    frame = build_model_frame(spark, config, args.station_id, args.lat, args.lon, args.target_var)
    if frame is None:
        logger.warning("nothing to write")
        return 1
    for path in write_model_frame(frame, config.output.folder, str(args.station_id), config.output.name, config.output.formats):
        logger.info("wrote %s", path)
    remove_scratch(spark, mark)
    logger.info("finished in %.1f s", time.perf_counter() - started)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

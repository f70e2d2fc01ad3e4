"""The scratch folder and the command line."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pytest

from skyloom import __main__ as cli
from skyloom import session


def fake(master, base=None):
    conf = SimpleNamespace(get=lambda key, default=None: base)
    context = SimpleNamespace(getConf=lambda: conf, master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_scratch_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("yarn"))
    assert session.shared_dir(fake("yarn", "hdfs://x/y")) == "hdfs://x/y"
    one = session.shared_dir(fake("local[2]"))
    assert one and one == session.shared_dir(fake("local[2]"))


def test_removed_scratch(spark):
    mark = session.scratch_mark()
    df = session.cut_lineage(spark.range(3))
    kept = session.scratch_path(spark, "kept")
    df.write.parquet(kept)
    session.remove_scratch(spark, mark, [kept])
    assert spark.read.parquet(kept).count() == 3 and session.scratch_mark() == mark + 1
    session.remove_scratch(spark, mark)
    assert session.scratch_mark() == mark


def test_command_line(spark, tmp_path):
    files = tmp_path / "obs"
    files.mkdir()
    rows = [(f"2020-01-{d:02d}", "01", 10 + d) for d in range(1, 7)]
    files.joinpath("72206013889_data.csv").write_text("date,hour,air_temp\n" + "".join(f"{d},{h},{t}\n" for d, h, t in rows))
    tmp_path.joinpath("stations.csv").write_text("stid,latitude,longitude\n72206013889,30.0,-81.0\n")
    config = {
        "stations_csv": str(tmp_path / "stations.csv"), "weather_dir": str(files), "agg_map": {"air_temp": ["mean"]}, "lookback_days": 1,
        "years_back": 2, "bins": [-9999, 1, 5, 20, 99999], "output_dir": str(tmp_path / "out"), "output_formats": ["parquet"],
    }
    path = tmp_path / "config.json"
    path.write_text(json.dumps(config))
    # main() ends no session: it uses the one of the tests
    assert cli.main(["--config", str(path), "--station-id", "72206013889", "--target-var", "air_temp_mean"]) == 0
    out = spark.read.parquet(str(tmp_path / "out" / "72206013889_pipeline.parquet"))
    assert "y" in out.columns and out.count() > 0
    assert cli.main(["--config", str(path), "--station-id", "1", "--target-var", "air_temp_mean"]) == 1

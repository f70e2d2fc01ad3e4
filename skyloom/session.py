"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", app: str = "skyloom") -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings every operator relies on."""
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled"):
        if spark.conf.get(key, None) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])
    return spark


_own_dirs: dict[str, str] = {}  # by application, for local sessions without the setting


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor reaches.

    A local session without that setting (tests) gets a temporary folder; on a cluster its absence is an error, as a
    folder of one machine loses data there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate results are stored there")
    return _own_dirs.setdefault(context.applicationId, tempfile.mkdtemp(prefix="skyloom-"))


_made: list[str] = []  # scratch paths of this process, in order


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def scratch_mark() -> int:
    """A place in the list of scratch paths, for ``remove_scratch``."""
    return len(_made)


def made_since(mark: int) -> list[str]:
    """Scratch paths after the mark."""
    return _made[mark:]


def remove_scratch(spark: SparkSession, since: int, keep: Collection[str] = ()) -> None:
    """Delete what was stored after the mark, but for the paths to keep. No frame that reads it may be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for made in _made[since:]:
        if made not in keep:
            path(made).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(made), True)
    _made[since:] = [p for p in _made[since:] if p in keep]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors, unlike a cached block."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session defaults, table access and lineage cuts on shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegate.errors import TidegateError

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "tidegate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every part of the engine assumes (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; times are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Where none is named, local mode gets a temporary folder; on a cluster that would be a different
    folder on every machine, so there it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    found = found or sc.getCheckpointDir()
    if not found:
        if not one_process(spark):
            raise TidegateError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        found = "file://" + tempfile.mkdtemp(prefix="tidegate-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def passing_dir(spark: SparkSession) -> str:
    """A new folder for tables that only this run reads; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidegate-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def one_process(spark: SparkSession) -> bool:
    """Whether the tasks run within the driver's own process."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table with fewer partitions than cores out to all cores; larger ones stay as they are.

    For work that costs far more than moving the rows, on tables that come in few small files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, no recomputation.

    The files survive the loss of executors. They are removed when the driver's Python ends,
    or earlier by ``drop``.
    """
    return cut_and_count(df, None)[0]


def cut_and_count(df: DataFrame, which: str | None) -> tuple[DataFrame, int]:
    """``cut``, and how many of the rows satisfy the SQL condition ``which``, counted as they are written."""
    spark = df.sparkSession
    path = passing_dir(spark)
    seen = Observation()
    counted = df if which is None else df.observe(seen, F.count_if(F.expr(which)).alias("n"))
    counted.write.option("compression", "lz4").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidegate_path = path
    return back, 0 if which is None else int(seen.get["n"])


def read_cuts(parts: list[DataFrame]) -> DataFrame:
    """The rows of several frames from ``cut`` that have the same columns in the same order, in one scan."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p._tidegate_path for p in parts])


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; other frames are left alone."""
    path = getattr(df, "_tidegate_path", None)
    if path:
        drop_dir(df.sparkSession, path)


def drop_dir(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        drop_dir(spark, path)

"""Session helpers: building a session and cutting lineage safely."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; set one only where neither the setting nor a folder exists (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
        named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)


_WRITTEN: list[tuple[SparkSession, str]] = []


def _forget() -> None:
    """Delete what cut() wrote, when the driver ends."""
    for spark, path in _WRITTEN:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the gateway may be gone
            return


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder and read from there: no lineage, and losing an executor loses nothing.

    A written table is computed once, where checkpoint() computes its last stage twice; it is columnar and compressed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}.parquet"
    if not _WRITTEN:
        atexit.register(_forget)
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The rows over at least twice as many partitions as there are cores, before a step of Python work.

    Moved by hash of the key; without one in turn, after the sort by which Spark makes that repeatable, so a lost task finds the same rows either way and
    repeated values do not gather in one task.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *key)

"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on whose machines it isn't installed."""
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/clipgraph", "zip", _ROOT, "clipgraph"))


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and local benchmarks; its Python workers find this package from any folder."""
    known = os.environ.get("PYTHONPATH", "")
    if str(_ROOT) not in known.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(_ROOT), known]))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("clipgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables, as the cluster names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path


def broadcast_checked(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    The count stops at the limit. Larger inputs take the ordinary shuffled join, whose skewed
    partitions the adaptive plan splits.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back from there.

    For inputs that several branches of a plan use and that are dear to compute;
    the written copy survives the loss of executors.
    """
    spark = df.sparkSession
    path = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint()

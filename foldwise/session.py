"""Session helpers: a local test session and the one place where lineage is cut."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "10g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foldwise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: their Python workers import it."""
    context = spark.sparkContext
    if getattr(context, "_foldwise_shipped", False):
        return
    home = Path(__file__).resolve().parent
    if home.parent.is_dir():
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{home.name}", "zip", home.parent, home.name))
    context._foldwise_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for settled tables.

    It is the one the cluster names in ``spark.checkpoint.dir``; only a local session without that
    setting gets a temporary folder of its own.
    """
    ship_package(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="foldwise-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage.

    Used for tables that two branches of a plan must see identically (approximate quantile edges,
    solver parameters) and between the dependent stages of a tuning run.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE on, skew join on)."""
    builder = (
        SparkSession.builder.appName("tessera")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a ``local`` session (tests, bench) may leave it unset and gets a scratch folder; on a cluster every
    executor would write to its own disk, so that is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, visible to every executor."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stable_copy(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(table: DataFrame, rows: int) -> int:
    """Partitions of at most about ``rows`` rows of a stored table (counted by its footers), enough for all cores."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // rows))


BROADCAST_ROWS = 200_000  # slide-sized tables beyond this are shuffled instead


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Bounded check before a broadcast: reads at most ``limit + 1`` rows."""
    return df.limit(limit + 1).count() <= limit


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session, so that they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tessera.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(target)
    context._tessera_shipped = True

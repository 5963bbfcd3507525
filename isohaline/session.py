"""Session set-up, size-checked broadcasts and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that may be broadcast by this package, in rows. A row of a selection cell or of a
# climatology is well under 300 bytes, so this stays below 150 MB on each executor.
BROADCAST_ROWS = 500_000


def local_session(cores: str = "8", partitions: int | None = None) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("isohaline")
        .config("spark.sql.shuffle.partitions", str(partitions or (cores if cores.isdigit() else 8)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ISOHALINE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when its files give fewer tasks than there are cores.

    For work that is heavy per row. A table of many files is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcast when a bounded count proves that it is small.

    The count stops at ``max_rows + 1`` rows, so the check costs at most that much. The caller gets the
    verdict and must have a shuffled way for the other case.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df), True) if small else (df, False)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage and survives the loss of executors; several branches then share one result.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/isohaline-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)

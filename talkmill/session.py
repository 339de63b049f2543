"""Session, checkpoint folder and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only after its rows were seen to be no larger than this, written as text.
BROADCAST_BYTES = 8 << 20


def get_spark(app: str = "talkmill", cpus: int | None = None, **conf) -> SparkSession:
    """Local session for tests and the bench; on a cluster the caller brings the session."""
    n = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach; set by the cluster in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="talkmill-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The partitions read back are the ones written, so ``spark_partition_id`` is stable, and a
    lost executor costs a read instead of the lineage.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Return ``small`` for a join: broadcast if its bytes were summed and fit, as it is if not.

    The rows are written to the checkpoint folder, so they are computed once, and their size is summed
    there; none reaches the driver. Only the plan depends on it. A table that does not fit stays
    distributed and the join shuffles, with adaptive skew handling for hot keys.
    """
    small = checkpointed(small)
    size = small.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(small) if size <= limit else small


def distinct_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values of ``column``: classes or folds, of which a model holds one part each."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def spread(df: DataFrame) -> DataFrame:
    """Repartition a table whose scan has fewer parts than the cluster has cores.

    A file with one row group, or one that cannot be split, is read by one task. Work per row that
    costs more than the scan then gains from a shuffle. A large table has parts enough and is
    left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

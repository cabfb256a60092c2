"""Session helpers: the settings the jobs expect, and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also split a skewed join whose output partitioning a later step would reuse.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoint files go once no table refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(app: str = "snapline", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings the session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_folders: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session, whose one process sees its own disk, may go without: it gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="snapline-")
    return _own_folders[context.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint a small table that later steps read many times. The job that computes it runs at once."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table over all cores before a step that multiplies its rows.

    Sizes in bytes say nothing about such a step, so Spark would leave it on a few tasks.
    """
    return df.repartition(parallelism(df.sparkSession), *keys)

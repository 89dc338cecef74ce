"""Session helpers.

Library functions never create sessions and never choose a folder of their
own; callers own both.  ``local_session`` is for tests, the bench and local runs.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "termspark",
                  driver_memory: str = "16g", checkpoint_dir: str | None = None) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The folder that driver and executors share for intermediate tables, as
    the session names it; None where it names none."""
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage.

    With a checkpoint folder in the session this is a reliable checkpoint that
    survives lost executors (removed again by Spark's cleaner when the session
    sets ``spark.cleaner.referenceTracking.cleanCheckpoints``).  Without one
    (some tests) the rows are persisted and keep their lineage, so a lost
    block is computed again; no folder is invented.
    """
    spark = df.sparkSession
    shared = checkpoint_dir(spark)
    if shared:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)

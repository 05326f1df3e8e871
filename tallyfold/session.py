"""Session defaults for local runs and tests; a cluster brings its own settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "tallyfold") -> SparkSession:
    shuffles = str(os.cpu_count() or 8) if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffles)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TALLYFOLD_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local run may leave that unset; a
    new temporary folder is made and set for it. On a cluster executors would not see such a folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


#: Shuffled rows here fill 25 times their compressed size and more when a task sorts them; Spark's own 64 MB would be gigabytes.
TARGET, TARGET_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m"


def bounded_tasks(spark: SparkSession) -> None:
    """Has Spark merge shuffle partitions to ``TARGET_SIZE`` only, unless the session names a size."""
    if spark.conf.get(TARGET, None) is None:
        spark.conf.set(TARGET, TARGET_SIZE)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files, which can be read in part."""
    bounded_tasks(df.sparkSession)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from what was written."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

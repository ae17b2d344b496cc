"""Local session for tests and the bench (a cluster passes its own session)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "daybook") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", os.environ.get("DAYBOOK_ADVISORY_BYTES", "64m"))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", os.environ.get("DAYBOOK_MIN_PARTITION_BYTES", "1m"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DAYBOOK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application: below the one that the session names, which all executors share.

    A local test session without one gets its own.  What this library puts there goes when the driver ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="daybook-checkpoint-"))
        _delete_on_exit(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a table that is written and read back."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

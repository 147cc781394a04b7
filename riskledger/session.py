"""Session defaults, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "riskledger", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the same settings in every mode."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # few bytes may still be much work, so small partitions are not all joined into one
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def _drop_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the driver ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of the application in the warehouse.

    The warehouse is shared wherever tables work; the application's folder in it goes when the driver ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_runs/{sc.applicationId}"
    _drop_at_end(spark, path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; it goes when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _drop_at_end(spark, path)
    return path


#: Whether the shuffle files of a statement go when it ends; it holds for checkpoints, not for writes.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds of work from which on the shuffle files it leaves are worth a collection of the driver's garbage.
LONG = 3.0


def _let_go(spark: SparkSession, began: float) -> None:
    """Have Spark delete the shuffle files of what has been written since ``began``.

    It does so when the driver's garbage is collected, which a driver that has little to do puts off: the files of
    all steps of a query would lie on the disks at once.
    """
    if time.monotonic() - began > LONG:
        for _ in range(2):  # the first one only frees what holds them
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: read many times and by column, it costs less than a checkpoint."""
    path, began = scratch(df.sparkSession, name), time.monotonic()
    df.write.parquet(path)
    _let_go(df.sparkSession, began)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:  # a plan of its own, made under the setting and not run again
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, was)

"""Tables that a stream's batches read and replace: versioned snapshots and a history keyed by batch.

A batch may run again after a failure, on another machine, with the same id and rows. So every write goes
to a folder named by the batch id, replaces what a first attempt left there, and starts from what
earlier batches wrote. A folder counts once its writer has committed it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None]) -> None:
    """Run ``step`` on every batch of what the stream's source holds now."""
    place = scratch(stream.sparkSession, "batches")
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", place).trigger(availableNow=True).start()
    q.awaitTermination()


class _Folders:
    """Folders ``name=<batch id>`` under a path, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name

    def folder(self, batch: int) -> str:
        return f"{self.path}/{self.name}={batch}"

    def committed(self) -> list[int]:
        """The ids of the folders that are whole, ascending."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        ids = [int(n.partition("=")[2]) for n in names if n.startswith(f"{self.name}=")]
        return sorted(i for i in ids if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder(i)}/_SUCCESS")))

    def drop(self, batch: int) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder(batch))
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class SnapshotStore:
    """A table of which each batch writes a new version from the one before.

    Readers see the newest whole version. ``keep`` versions stay, so a reader of the one before is not cut off.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keep: int = 2):
        self.spark, self.schema, self.keep = spark, schema, keep
        self.folders = _Folders(spark, path, "version")

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest one of a batch earlier than ``before``; empty if there is none."""
        ids = [i for i in self.folders.committed() if before is None or i < before]
        if not ids:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folders.folder(ids[-1]))

    def update(self, batch: int, change: Callable[[DataFrame], DataFrame]) -> None:
        """Write the version of ``batch``: ``change`` of the version before it, whether or not it was written already."""
        change(self.read(batch)).write.mode("overwrite").parquet(self.folders.folder(batch))
        for old in self.folders.committed()[: -self.keep]:
            self.folders.drop(old)


class HistoryStore:
    """Rows of all batches, by batch and day, read by key and time."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, time: str):
        self.spark, self.schema, self.key, self.time = spark, schema, key, time
        self.folders = _Folders(spark, path, "batch_id")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Keep the rows of ``batch``; a repeated batch replaces its own."""
        rows.select(*self.schema.fieldNames()).withColumn("day", F.to_date(self.time)).write.mode("overwrite").partitionBy("day").parquet(self.folders.folder(batch))

    def before(self, rows: DataFrame, batch: int, days: int | None = None) -> DataFrame:
        """Rows of earlier batches that share a key with ``rows``; with ``days`` only from so long before the first of them.

        Days are folders, so older ones are not read; the keys are joined, never collected.
        """
        ids = [i for i in self.folders.committed() if i < batch]
        if not ids:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("day", T.DateType()), T.StructField("batch_id", T.IntegerType())])
        past = self.spark.read.schema(schema).option("basePath", self.folders.path).parquet(*map(self.folders.folder, ids))
        if days is not None:
            first = rows.agg(F.min(F.to_date(self.time))).first()[0]
            past = past.where(F.col("day") >= F.date_sub(F.lit(first).cast("date"), days))
        return past.join(rows.select(self.key).distinct(), self.key, "left_semi").select(*self.schema.fieldNames())

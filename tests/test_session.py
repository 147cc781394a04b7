import time

import pytest
from pyspark.sql import functions as F

from riskledger import session


def _shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


@pytest.mark.parametrize("write", [lambda df: session.stored(df, "step"), session.checkpointed])
def test_shuffle_files_go_after_a_long_write(spark, monkeypatch, write):
    monkeypatch.setattr(session, "LONG", 0.0, raising=False)
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = _shuffle_files(spark)
    df = spark.range(200_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s")).repartition(4, "s")
    out = write(df)
    end = time.monotonic() + 20
    while _shuffle_files(spark) > before and time.monotonic() < end:
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before
    assert out.count() == 1000

"""Exact global order statistics without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

REVIEW_RATES = {"conservative": 0.05, "balanced": 0.08, "aggressive": 0.12}


def global_position(df: DataFrame, order: list[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of every row in the total order ``order``.

    The frame is range-partitioned and checkpointed with its partition number, so
    the sampled range bounds cannot move between the two reads; positions are the
    row number inside a range plus the rows of the ranges before it. ``order``
    must end in a unique column, which also splits a value held by most rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_rn", inside)
        .join(F.broadcast(offsets), "_range")  # one row per range
        .withColumn(name, (F.col("_offset") + F.col("_rn") - 1).cast("long"))
        .drop("_range", "_rn", "_offset")
    )


def percentile_rank(df: DataFrame, value: str, row_id: str, name: str) -> DataFrame:
    """Position in ascending (value, row_id) order divided by n-1."""
    total = df.agg(F.count("*").alias("_total"))
    placed = global_position(df, [F.col(value).asc(), F.col(row_id).asc()], "_pos")
    return (
        placed.join(F.broadcast(total))  # one row
        .withColumn(name, F.col("_pos") / F.greatest(F.lit(1), F.col("_total") - 1))
        .drop("_pos", "_total")
    )


def review_rate(profile="balanced", rate=None, false_positive_cost=None, false_negative_cost=None) -> tuple[str, float]:
    """Which rule sets the review rate: costs, then an explicit rate, then the profile."""
    if false_positive_cost is not None and false_negative_cost is not None:
        fp, fn = max(0.01, float(false_positive_cost)), max(0.01, float(false_negative_cost))
        return "cost_aware", max(0.03, min(0.20, 0.03 + 0.17 * fn / (fp + fn)))
    if rate is not None:
        return "custom", max(0.0, min(1.0, float(rate)))
    return profile, REVIEW_RATES.get(profile, REVIEW_RATES["balanced"])


def score_threshold(df: DataFrame, score: str, rate: float, digits: int = 4) -> DataFrame:
    """One row: the kth largest score, k = round(n * rate) to even, at least 1.

    Scores carry ``digits`` decimals, so at most ``10**digits + 1`` distinct values
    remain after the grouped count and the cumulative window over them is small.
    """
    if rate <= 0:
        return df.sparkSession.range(1).select(F.lit(1.0).alias("threshold"))
    counts = df.groupBy(F.round(score, digits).alias("_s")).agg(F.count("*").alias("_c"))
    total = F.sum("_c").over(Window.partitionBy())
    seen = F.sum("_c").over(Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0))
    k = F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.col("_n") * F.lit(rate)).cast("long")))
    at = counts.select("_s", total.alias("_n"), seen.alias("_seen")).filter(F.col("_seen") >= k)
    return at.agg(F.coalesce(F.max("_s"), F.lit(1.0)).alias("threshold"))


def time_split(df: DataFrame, us: str, row_id: str, train_ratio: float, valid_ratio: float) -> DataFrame:
    """Label rows train / valid / test by time order; every part keeps at least one row.

    Fewer than three rows are all used for training.
    """
    total = df.agg(F.count("*").alias("_total"))
    placed = global_position(df, [F.col(us).asc(), F.col(row_id).asc()], "_pos").join(F.broadcast(total))  # one row
    n = F.col("_total")
    train_end = F.greatest(F.lit(1), F.least(n - 2, F.round(n * train_ratio))).cast("long")
    valid_end = F.greatest(train_end + 1, F.least(n - 1, F.round(n * valid_ratio))).cast("long")
    part = F.when((n < 3) | (F.col("_pos") < train_end), "train").when(F.col("_pos") < valid_end, "valid").otherwise("test")
    return placed.withColumn("split", part).drop("_pos", "_total")

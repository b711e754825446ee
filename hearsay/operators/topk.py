"""Top-k rows, per group or overall, without one task seeing every candidate.

``row_number() <= k`` is planned with a partial limit before the shuffle, so each map task
sends at most k rows per group, whatever k is. With very many map tasks one hot group would
still receive k rows from each of them. A first round therefore merges map tasks in ``fan_in``
slots, and only ``fan_in * k`` rows per group reach the second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAN_IN = 64
LIMIT_THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"


def limit_before_shuffle(spark: SparkSession, k: int) -> None:
    """Plan the partial limit for ``k`` too: by default Spark leaves it out above 1000."""
    if int(spark.conf.get(LIMIT_THRESHOLD)) < k:
        spark.conf.set(LIMIT_THRESHOLD, str(k))


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, fan_in: int = FAN_IN
) -> DataFrame:
    """The first ``k`` rows of every group. ``order`` must be total for repeatable ties."""
    limit_before_shuffle(df.sparkSession, k)
    slots = Window.partitionBy(*group, "_slot").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_slot", F.spark_partition_id() % fan_in)
        .withColumn("_rank", F.row_number().over(slots))
        .where(F.col("_rank") <= k)
        .drop("_slot", "_rank")
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= k)
        .drop("_rank")
    )


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows, sorted. Every task keeps a heap of ``k`` rows; only these are sent."""
    return df.orderBy(*order).limit(k)

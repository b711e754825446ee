"""Counts and ranges from Parquet footers alone.

Spark's second-generation reader can answer ``count``, ``min`` and ``max`` from the statistics that every
Parquet file carries at its end. No row group is opened, so row counts and date ranges of stored layers
cost one small read per file, whatever the number of posts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.config import Settings

CONF = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def footer_reading(spark: SparkSession) -> Iterator[None]:
    """Plan and run aggregates over files from their footers; the settings are restored after."""
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored_aggregate(spark: SparkSession, settings: Settings, layer: str, *values: Column) -> DataFrame:
    """``values`` over a layer's files, for use inside ``footer_reading``. A table of the session's own
    format is read by its folder."""
    table = settings.table(layer)
    place = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").first()[1]
    return spark.read.parquet(place).agg(*values)


def count_stored(spark: SparkSession, settings: Settings, layer: str) -> int:
    """Rows of a stored layer; a layer without files has none."""
    with footer_reading(spark):
        return stored_aggregate(spark, settings, layer, F.count("*")).first()[0] or 0


def stored_date_range(spark: SparkSession, settings: Settings, layer: str) -> tuple[date, date] | None:
    """First and last UTC post date of a stored layer, or None when it holds none."""
    with footer_reading(spark):
        low, high = stored_aggregate(spark, settings, layer, F.min("created_utc"), F.max("created_utc")).first()
    if low is None:
        return None
    first = date(1970, 1, 1)
    return first + timedelta(days=low // 86400), first + timedelta(days=high // 86400)

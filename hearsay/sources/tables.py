"""Stored layers and the one-row load state."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as t

from hearsay.config import Settings

PROGRESS_SCHEMA = t.StructType([
    t.StructField("year", t.StringType(), False),
    t.StructField("month", t.StringType(), False),
    t.StructField("day", t.IntegerType(), False),
    t.StructField("last_updated", t.TimestampType(), False),
])

STAGED_COLUMNS = (
    "id", "author", "subreddit", "title", "selftext", "score", "created_at", "created_utc",
    "num_comments", "url", "over_18", "link_flair_text", "author_flair_text", "is_bot",
    "sentiment", "sentiment_confidence", "emotion", "emotion_confidence", "topic",
    "topic_confidence", "load_date",
)


@dataclass(frozen=True)
class Progress:
    """The next day to load."""

    next_day: date

    def after(self) -> Progress:
        """The state once ``next_day`` is loaded."""
        return Progress(self.next_day + timedelta(days=1))

    def to_frame(self, spark: SparkSession, now: datetime | None = None) -> DataFrame:
        day, at = self.next_day, now or datetime.now(timezone.utc)
        row = (f"{day.year:04d}", f"{day.month:02d}", day.day, at)
        return spark.createDataFrame([row], PROGRESS_SCHEMA)


def layer_exists(spark: SparkSession, settings: Settings, layer: str) -> bool:
    """Is the layer's table there?"""
    return spark.catalog.tableExists(settings.table(layer))


def read_layer(spark: SparkSession, settings: Settings, layer: str) -> DataFrame:
    """A stored layer or mart."""
    return spark.table(settings.table(layer))


def read_progress(spark: SparkSession, settings: Settings) -> Progress:
    """The stored state, or the configured first day when nothing was stored yet."""
    if not layer_exists(spark, settings, "progress"):
        return Progress(settings.start)
    row = read_layer(spark, settings, "progress").first()
    if row is None:
        return Progress(settings.start)
    return Progress(date(int(row["year"]), int(row["month"]), row["day"]))


def stage_gold(gold: DataFrame, view: str | None = None, dated: bool = False) -> DataFrame:
    """The staged columns of gold, in order; ``view`` also names them as a temporary view.

    ``dated`` keeps ``post_date`` as a last column where gold is stored by it, so that a range of days over
    the staged posts opens the folders of these days only. Gold without that column is staged as usual.
    """
    days = ["post_date"] if dated and "post_date" in gold.columns else []
    staged = gold.select(*STAGED_COLUMNS, *days)
    if view is not None:
        staged.createOrReplaceTempView(view)
    return staged

"""Incremental load of bronze: the top posts of each day, resumable from one state row.

The day's partition is written before the state, so a crash in between repeats the day and
replaces the same partition.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.config import Settings
from hearsay.functions.filters import on_day, on_days, safe_only, utc_date
from hearsay.operators.clean import stamp_load
from hearsay.operators.topk import top_per_group, top_rows
from hearsay.session import frees_shuffles
from hearsay.sinks.tables import (
    DAY_COLUMN, advance_progress, drop_empty_days, ensure_namespace, reset_month, write_day, write_days,
    write_progress,
)
from hearsay.sources.submissions import read_submissions
from hearsay.sources.tables import Progress, read_progress


def _order() -> list:
    return [F.col("score").desc_nulls_last(), F.col("id").asc()]


def top_posts(raw: DataFrame, day: date, k: int = 100) -> DataFrame:
    """The ``k`` safe posts of one day with the highest scores."""
    return top_rows(raw.transform(safe_only).transform(on_day, day), _order(), k)


def top_posts_per_day(raw: DataFrame, first: date, last: date, k: int = 100) -> DataFrame:
    """The same for every day of a range in one pass; adds the day as ``load_day``."""
    posts = raw.transform(safe_only).transform(on_days, first, last)
    posts = posts.withColumn(DAY_COLUMN, utc_date(F.col("created_utc")))
    return top_per_group(posts, [DAY_COLUMN], _order(), k)


def _months_differ(a: date, b: date) -> bool:
    return (a.year, a.month) != (b.year, b.month)


@frees_shuffles
def run_day(
    spark: SparkSession, settings: Settings, root: str, layout: str = "path",
    at: datetime | None = None,
) -> Progress:
    """Load the day in the state row, then advance the state; returns the new state.

    Bronze is emptied by the first load of a month, unless ``retain_months`` is set. The last
    day of a month thus stays readable until the next month begins. A day without posts
    advances the state too.
    """
    ensure_namespace(spark, settings)
    state = read_progress(spark, settings)
    day = state.next_day
    if day.day == 1 and not settings.retain_months:
        reset_month(spark, settings)
    raw = read_submissions(spark, root, day, layout=layout)
    posts = stamp_load(top_posts(raw, day, settings.posts_per_day), at)
    write_day(posts, settings, day)
    return advance_progress(spark, settings, state)


@frees_shuffles
def run_range(
    spark: SparkSession, settings: Settings, root: str, last: date, layout: str = "path",
    at: datetime | None = None,
) -> Progress:
    """Catch up from the state row to ``last`` in one job: every day of the range is loaded.

    Without ``retain_months`` a range that begins a month, or spans several, first clears what
    bronze holds from before it. Days of the range that came back empty lose the rows an earlier
    run wrote for them, as with daily runs.
    """
    ensure_namespace(spark, settings)
    state = read_progress(spark, settings)
    first = state.next_day
    if last < first:
        return state
    if not settings.retain_months and (first.day == 1 or _months_differ(first, last)):
        reset_month(spark, settings)
    raw = read_submissions(spark, root, first, last, layout)
    posts = stamp_load(top_posts_per_day(raw, first, last, settings.posts_per_day), at).persist()
    write_days(posts, settings)
    drop_empty_days(spark, settings, posts, first, last)
    posts.unpersist()
    following = Progress(last).after()
    write_progress(spark, settings, following)
    return following

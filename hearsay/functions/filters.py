"""Row filters. All of them are plain predicates, so Catalyst pushes them into the scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_SUBREDDITS = "All Subreddits"


def epoch(day: date) -> int:
    """Seconds from 1970-01-01 to the start of a UTC day."""
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp())


def utc_date(seconds: Column) -> Column:
    """UTC date of an epoch second, whatever the session's time zone."""
    days = F.floor(seconds / F.lit(86400)).cast("int")
    return F.date_add(F.lit(date(1970, 1, 1)), days)


def post_date() -> Column:
    """UTC date of a post. ``created_utc`` gives it without asking for a time zone, whichever
    timestamp type ``created_at`` has."""
    return utc_date(F.col("created_utc"))


def day_of(df: DataFrame) -> Column:
    """Post date of a frame's rows: in UTC where it has ``created_utc``, else the date of
    ``created_at`` as it stands."""
    return post_date() if "created_utc" in df.columns else F.to_date("created_at")


def safe_only(df: DataFrame) -> DataFrame:
    """Drop posts marked ``over_18``; an unknown mark counts as safe."""
    return df.where(F.col("over_18").isNull() | ~F.col("over_18"))


def on_days(df: DataFrame, first: date, last: date) -> DataFrame:
    """Posts created from the start of ``first`` to the end of ``last``, in UTC."""
    created = F.col("created_utc")
    return df.where((created >= epoch(first)) & (created < epoch(last + timedelta(days=1))))


def on_day(df: DataFrame, day: date) -> DataFrame:
    """Posts created on one UTC day."""
    return on_days(df, day, day)


def between_days(df: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """Posts whose ``created_at`` date lies in ``[start, end]``; None leaves a side open."""
    df = df.where(chosen(df, start, end))
    if "post_date" in df.columns:  # a layer partitioned by post date is also pruned by it
        df = df.where(_between(F.col("post_date"), start, end))
    return df


def _between(day: Column, start: date | None, end: date | None) -> Column:
    from_start = F.lit(True) if start is None else day >= F.lit(start)
    return from_start if end is None else from_start & (day <= F.lit(end))


def chosen(
    df: DataFrame, start: date | None = None, end: date | None = None,
    subreddits: Sequence[str] | None = None,
) -> Column:
    """The conditions of ``between_days`` and ``in_subreddits`` as one predicate, for steps that
    spare the other rows some work but must keep them."""
    if "created_utc" in df.columns:  # plain comparisons, which reach the scan
        met, created = F.lit(True), F.col("created_utc")
        met = met if start is None else met & (created >= epoch(start))
        met = met if end is None else met & (created < epoch(end + timedelta(days=1)))
    else:
        met = _between(F.to_date("created_at"), start, end)
    if subreddits and ALL_SUBREDDITS not in subreddits:
        met = met & F.col("subreddit").isin(list(subreddits))
    return met


def in_subreddits(df: DataFrame, subreddits: Sequence[str] | None) -> DataFrame:
    """Keep the listed subreddits; an empty list, or one naming "All Subreddits", keeps all."""
    if not subreddits or ALL_SUBREDDITS in subreddits:
        return df
    return df.where(F.col("subreddit").isin(list(subreddits)))


def confident(df: DataFrame, label: str, above: float, kind: str = "sentiment") -> DataFrame:
    """Posts with the given label and a confidence above the threshold."""
    return df.where((F.col(kind) == label) & (F.col(f"{kind}_confidence") > above))

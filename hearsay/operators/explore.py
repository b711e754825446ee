"""Filtered exploration queries: every one takes a date range, most take subreddits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.filters import between_days, confident, day_of, in_subreddits
from hearsay.functions.numbers import avg_to, total
from hearsay.operators.topk import top_rows

PAGE_COLUMNS = (
    "id", "subreddit", "author", "title", "score", "num_comments", "post_date", "url",
)

# The two sizes a page can be re-sorted by, apart from "recent".
PAGE_SORTS = {"score": "score", "comments": "num_comments"}


def _chosen(
    df: DataFrame, start: date | None, end: date | None, subreddits: Sequence[str] | None
) -> DataFrame:
    return df.transform(between_days, start, end).transform(in_subreddits, subreddits)


def kpis(
    posts: DataFrame, start: date | None = None, end: date | None = None,
    subreddits: Sequence[str] | None = None,
) -> DataFrame:
    """Headline numbers of the chosen posts; engagement is comments per post."""
    rows = F.count(F.lit(1))
    comments = total("num_comments")
    engagement = F.when(rows > 0, comments / rows).otherwise(F.lit(0.0))
    return _chosen(posts, start, end, subreddits).agg(
        rows.alias("total_posts"),
        total("score").alias("total_score"),
        avg_to("score", 1).alias("avg_score"),
        comments.alias("total_comments"),
        avg_to("num_comments", 1).alias("avg_comments"),
        F.count_distinct("subreddit").alias("unique_subreddits"),
        F.count_distinct("author").alias("unique_authors"),
        engagement.alias("engagement_rate"),
    )


def daily_trends(
    posts: DataFrame, start: date | None = None, end: date | None = None,
    subreddits: Sequence[str] | None = None,
) -> DataFrame:
    """Posts, score and comments per date, oldest first."""
    return (
        _chosen(posts, start, end, subreddits)
        .groupBy(day_of(posts).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.sum("score").alias("total_score"),
            F.sum("num_comments").alias("comments"),
        )
        .orderBy("date")
    )


def top_subreddits(
    posts: DataFrame, start: date | None = None, end: date | None = None, k: int = 10
) -> DataFrame:
    """Subreddits with most posts, with total and average score."""
    return (
        between_days(posts, start, end)
        .groupBy("subreddit")
        .agg(
            F.count(F.lit(1)).alias("post_count"),
            F.sum("score").alias("total_score"),
            avg_to("score", 1).alias("avg_score"),
        )
        .orderBy(F.col("post_count").desc(), "subreddit")
        .limit(k)
    )


def dominant_sentiment(
    gold: DataFrame, start: date | None = None, end: date | None = None, k: int = 10
) -> DataFrame:
    """The most frequent sentiment of each subreddit; the ``k`` largest of them.

    The window runs over the counts, at most one row per subreddit and sentiment.
    """
    by_count = Window.partitionBy("subreddit").orderBy(F.col("count").desc(), "sentiment")
    return (
        between_days(gold, start, end)
        .groupBy("subreddit", "sentiment").agg(F.count(F.lit(1)).alias("count"))
        .withColumn("_rank", F.row_number().over(by_count))
        .where(F.col("_rank") == 1)
        .select("subreddit", "sentiment", "count")
        .orderBy(F.col("count").desc(), "subreddit")
        .limit(k)
    )


def distribution(
    gold: DataFrame, kind: str, start: date | None = None, end: date | None = None,
    subreddits: Sequence[str] | None = None, k: int | None = None,
) -> DataFrame:
    """Posts per label of one kind, largest first, optionally the top ``k`` labels."""
    counts = (
        _chosen(gold, start, end, subreddits)
        .groupBy(kind).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), kind)
    )
    return counts if k is None else counts.limit(k)


def available_dates(posts: DataFrame, today: date | None = None) -> DataFrame:
    """First and last post date; the last thirty days when there are no posts."""
    now = F.current_date() if today is None else F.lit(today)
    return posts.agg(
        F.coalesce(F.min(day_of(posts)), F.date_sub(now, 30)).alias("min_date"),
        F.coalesce(F.max(day_of(posts)), now).alias("max_date"),
    )


def available_subreddits(posts: DataFrame) -> DataFrame:
    """Distinct subreddit names in order."""
    return (
        posts.where(F.col("subreddit").isNotNull())
        .select("subreddit").distinct().orderBy("subreddit")
    )


def _largest_first(column: str) -> list[Column]:
    return [F.col(column).desc_nulls_last(), F.col("id").asc()]


def explore(
    posts: DataFrame, start: date | None = None, end: date | None = None,
    subreddits: Sequence[str] | None = None, sort: str = "recent", limit: int = 100,
    sort_scope: str = "page",
) -> DataFrame:
    """A page of posts.

    With ``sort_scope="page"`` the page holds the latest ``limit`` posts and ``sort`` only
    rearranges it; with "all" the sort decides which posts the page holds.
    """
    if sort != "recent" and sort not in PAGE_SORTS:
        raise ValueError(f"unknown sort: {sort}")
    if sort_scope not in ("page", "all"):
        raise ValueError(f"unknown sort scope: {sort_scope}")
    chosen = _chosen(posts, start, end, subreddits)
    columns = [
        day_of(chosen).alias(c) if c == "post_date" else F.col(c) for c in PAGE_COLUMNS
    ]
    recent = _largest_first("created_at")
    wanted = recent if sort == "recent" else _largest_first(PAGE_SORTS[sort])
    first = wanted if sort_scope == "all" else recent
    page = top_rows(chosen.select(*columns, "created_at"), first, limit)
    if first is not wanted:
        page = page.orderBy(*wanted)
    return page.drop("created_at")


def confident_posts(
    gold: DataFrame, label: str = "negative", above: float = 0.8, limit: int | None = None
) -> DataFrame:
    """Posts with a sure sentiment, highest score first.

    With a limit this is a top-k. Without one it is a full sort: range partitioned and
    spilled, never gathered.
    """
    chosen = confident(gold, label, above)
    columns = ("id", "title", "sentiment", "sentiment_confidence", "score")
    order = _largest_first("score")
    if limit is None:
        return chosen.select(*columns).orderBy(*order)
    return top_rows(chosen.select(*columns), order, limit)


def sample_rows(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """A few rows to look at, the first by id so that a rerun shows the same ones."""
    return top_rows(df.select("id", *[c for c in columns if c != "id"]), [F.col("id").asc()], k)


def rows_of_first(df: DataFrame, k: int, key: str = "id") -> DataFrame:
    """All rows of the ``k`` smallest keys, null before all others. What chooses one row per key and then takes
    the first ``k`` by key gives the same from these rows; only the keys are shuffled, and ``k`` of them are collected."""
    keys = [r[0] for r in top_rows(df.select(key).distinct(), [F.col(key).asc()], k).collect()]
    chosen = F.col(key).isin([v for v in keys if v is not None])
    return df.where(chosen | F.col(key).isNull() if None in keys else chosen)

"""Summaries of labelled posts.

Every summary is a hash aggregate with a partial phase in the map tasks, so a subreddit or a
day that holds a third of all posts reaches the reducer as a few partial rows. None of them
sorts; a stored table keeps no order, and readers sort what they fetch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.filters import day_of
from hearsay.functions.numbers import (
    avg_confidence, avg_to, confidence, exact_avg_confidence, percent, ratio_to,
)
from hearsay.functions.text import metric_key

SENTIMENTS = ("positive", "negative", "neutral")


def _rows() -> Column:
    return F.count(F.lit(1))


def _sentiment_counts(suffix: str) -> list[Column]:
    return [F.count_if(F.col("sentiment") == s).alias(f"{s}_{suffix}") for s in SENTIMENTS]


def _post_date(df: DataFrame) -> Column:
    return day_of(df).alias("post_date")


def bronze_summary(df: DataFrame, days: int = 31) -> DataFrame:
    """Posts, scores, subreddits and authors per post date; the newest ``days`` dates."""
    return (
        df.groupBy(_post_date(df))
        .agg(
            _rows().alias("post_count"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
            F.avg("score").alias("avg_score"),
            F.count_distinct("subreddit").alias("unique_subreddits"),
            F.count_distinct("author").alias("unique_authors"),
        )
        .orderBy(F.col("post_date").desc_nulls_last())
        .limit(days)
    )


def load_summary(df: DataFrame) -> DataFrame:
    """Score range and number of subreddits of one load."""
    return df.agg(
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.count_distinct("subreddit").alias("unique_subreddits"),
    )


def most_frequent_subreddits(df: DataFrame, k: int = 5) -> DataFrame:
    """The subreddits with most posts in one load."""
    return (
        df.where(F.col("subreddit").isNotNull())
        .groupBy("subreddit").agg(_rows().alias("post_count"))
        .orderBy(F.col("post_count").desc(), "subreddit").limit(k)
    )


def sentiment_by_subreddit(gold: DataFrame) -> DataFrame:
    """Sentiment mix and engagement per subreddit."""
    shares = [
        percent(F.count_if(F.col("sentiment") == s), _rows()).alias(f"{s}_pct") for s in SENTIMENTS
    ]
    return (
        gold.where(F.col("subreddit").isNotNull())
        .groupBy("subreddit")
        .agg(
            _rows().alias("total_posts"),
            *_sentiment_counts("count"),
            *shares,
            avg_confidence("sentiment_confidence").alias("avg_sentiment_confidence"),
            avg_to("score", 2).alias("avg_score"),
            F.max("score").alias("max_score"),
            F.sum("score").alias("total_score"),
            avg_to("num_comments", 2).alias("avg_comments"),
            F.max("num_comments").alias("max_comments"),
        )
    )


def topic_trends(gold: DataFrame) -> DataFrame:
    """Sentiment mix, confidence, engagement and subreddits per topic.

    Posts are first reduced to one row per (topic, subreddit). The list of subreddits is then
    built from distinct values only, and it is the only thing a task holds whole: it is one
    cell of the result.
    """
    per_pair = (
        gold.where(F.col("topic").isNotNull())
        .groupBy("topic", "subreddit")
        .agg(
            _rows().alias("n"),
            *_sentiment_counts("posts"),
            F.sum(confidence("topic_confidence")).alias("topic_sum"),
            F.count("topic_confidence").alias("topic_n"),
            F.sum(confidence("sentiment_confidence")).alias("sentiment_sum"),
            F.count("sentiment_confidence").alias("sentiment_n"),
            F.sum("score").alias("score_sum"),
            F.count("score").alias("score_n"),
            F.max("score").alias("score_max"),
            F.sum("num_comments").alias("comments_sum"),
            F.count("num_comments").alias("comments_n"),
        )
    )

    def average(prefix: str, places: int) -> Column:
        whole = F.sum(f"{prefix}_sum").cast("double")
        return ratio_to(whole, F.sum(f"{prefix}_n"), places)

    return per_pair.groupBy("topic").agg(
        F.sum("n").alias("post_count"),
        *[F.sum(f"{s}_posts").alias(f"{s}_posts") for s in SENTIMENTS],
        average("topic", 3).alias("avg_topic_confidence"),
        average("sentiment", 3).alias("avg_sentiment_confidence"),
        average("score", 2).alias("avg_score"),
        F.max("score_max").alias("top_score"),
        average("comments", 2).alias("avg_comments"),
        F.array_sort(F.collect_list("subreddit")).alias("related_subreddits"),
    )


def emotion_analysis(gold: DataFrame) -> DataFrame:
    """Share, confidence, sentiment mix and engagement per emotion.

    The grand total is a window over the aggregate: one row per emotion label, so the single
    partition it needs is as small as the label set.
    """
    everything = Window.partitionBy()
    counted = (
        gold.where(F.col("emotion").isNotNull())
        .groupBy("emotion")
        .agg(
            _rows().alias("post_count"),
            avg_confidence("emotion_confidence").alias("avg_confidence"),
            F.round(F.min("emotion_confidence"), 3).alias("min_confidence"),
            F.round(F.max("emotion_confidence"), 3).alias("max_confidence"),
            *_sentiment_counts("sentiment_count"),
            avg_to("score", 2).alias("avg_score"),
            F.max("score").alias("highest_score"),
            avg_to("num_comments", 2).alias("avg_comments"),
        )
    )
    share = percent(F.col("post_count"), F.sum("post_count").over(everything))
    return counted.select(
        "emotion", "post_count", share.alias("percentage"), *counted.columns[2:]
    )


def daily_metrics(gold: DataFrame) -> DataFrame:
    """Posts, sentiment mix, engagement, distinct counts and confidence per post date.

    Posts are reduced to one row of sums per (date, subreddit, author) first; only these rows
    are repeated for the two distinct counts. Topics go along as a set per row.
    """
    kinds = ("sentiment", "emotion", "topic")
    sums = [F.sum(confidence(f"{k}_confidence")).alias(f"_{k}_sum") for k in kinds]
    counts = [F.count(f"{k}_confidence").alias(f"_{k}_n") for k in kinds]
    parts = (
        gold.where(F.col("created_at").isNotNull())
        .groupBy(_post_date(gold), "subreddit", "author")
        .agg(
            _rows().alias("_n"), *_sentiment_counts("posts"), *sums, *counts,
            F.sum("score").alias("_score_sum"), F.count("score").alias("_score_n"),
            F.max("score").alias("_score_max"), F.sum("num_comments").alias("_comments_sum"),
            F.count("num_comments").alias("_comments_n"),
            F.sort_array(F.collect_set("topic")).alias("_topics"),
        )
    )

    def average(prefix: str, places: int) -> Column:
        return ratio_to(F.sum(f"{prefix}_sum").cast("double"), F.sum(f"{prefix}_n"), places)

    days = parts.groupBy("post_date").agg(
        F.sum("_n").alias("total_posts"),
        *[F.sum(f"{s}_posts").alias(f"{s}_posts") for s in SENTIMENTS],
        average("_score", 2).alias("avg_score"),
        F.max("_score_max").alias("top_score"),
        F.sum("_score_sum").alias("total_score"),
        average("_comments", 2).alias("avg_comments"),
        F.count_distinct("subreddit").alias("unique_subreddits"),
        F.count_distinct("author").alias("unique_authors"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_topics")))).cast("bigint").alias("unique_topics"),
        *[average(f"_{k}", 3).alias(f"avg_{k}_confidence") for k in kinds],
    )
    return days


def label_distribution(gold: DataFrame, kind: str) -> DataFrame:
    """Posts and average confidence per label of one kind (sentiment, emotion or topic)."""
    return (
        gold.groupBy(kind)
        .agg(_rows().alias("count"), avg_confidence(f"{kind}_confidence").alias("avg_confidence"))
        .orderBy(F.col("count").desc(), kind)
    )


def label_metrics(
    gold: DataFrame, kinds: Sequence[str] = ("sentiment", "emotion", "topic")
) -> DataFrame:
    """(key, value) rows: posts per label of every kind, and all posts together.

    The kinds are unpivoted into an array per row and counted in one pass, so the labelled
    frame is read once; map tasks send one row per distinct key.
    """
    keys = [F.when(F.col(k).isNotNull(), metric_key(k, F.col(k))) for k in kinds]
    keys.append(F.lit("total_records_processed"))
    return (
        gold.select(F.explode(F.array(*keys)).alias("key"))
        .where(F.col("key").isNotNull())
        .groupBy("key").agg(_rows().alias("value"))
    )


def sentiment_heatmap(gold: DataFrame) -> DataFrame:
    """One row per subreddit, one column per sentiment."""
    return (
        gold.groupBy("subreddit").pivot("sentiment", list(SENTIMENTS)).count()
        .fillna(0, subset=list(SENTIMENTS))
    )


def emotion_by_subreddit(gold: DataFrame) -> DataFrame:
    """Posts and average confidence per subreddit and emotion."""
    average = exact_avg_confidence("emotion_confidence")
    return (
        gold.groupBy("subreddit", "emotion")
        .agg(_rows().alias("count"), average.alias("avg_confidence"))
        .orderBy(F.col("count").desc(), "subreddit", "emotion")
    )


def topics_over_time(gold: DataFrame) -> DataFrame:
    """Posts per post date and topic, newest and largest first."""
    return (
        gold.groupBy(day_of(gold).alias("date"), "topic")
        .agg(_rows().alias("posts"))
        .orderBy(F.col("date").desc(), F.col("posts").desc(), "topic")
    )


def topic_scores(gold: DataFrame) -> DataFrame:
    """Posts and average score per topic."""
    return (
        gold.groupBy("topic")
        .agg(_rows().alias("post_count"), F.avg("score").alias("avg_score"))
        .orderBy(F.col("post_count").desc(), "topic")
    )


def top_subreddit_sentiment(mart: DataFrame, k: int = 10) -> DataFrame:
    """Reader of ``sentiment_by_subreddit``: the largest subreddits."""
    return (
        mart.select("subreddit", "positive_pct", "negative_pct", "total_posts")
        .orderBy(F.col("total_posts").desc(), "subreddit").limit(k)
    )


def topics_by_posts(mart: DataFrame) -> DataFrame:
    """Reader of ``topic_trends``: topics by number of posts."""
    return (
        mart.select("topic", "post_count", "avg_score")
        .orderBy(F.col("post_count").desc(), "topic")
    )


def daily_sentiment(mart: DataFrame) -> DataFrame:
    """Reader of ``daily_metrics``: sentiment per date, newest first."""
    return (
        mart.select("post_date", "positive_posts", "negative_posts", "neutral_posts")
        .orderBy(F.col("post_date").desc())
    )


BUILDERS = {
    "sentiment_by_subreddit": sentiment_by_subreddit,
    "topic_trends": topic_trends,
    "emotion_analysis": emotion_analysis,
    "daily_metrics": daily_metrics,
}

# How a reader sorts a stored mart: biggest or newest first.
MART_ORDER = {
    "sentiment_by_subreddit": ("total_posts", "subreddit"),
    "topic_trends": ("post_count", "topic"),
    "emotion_analysis": ("post_count", "emotion"),
    "daily_metrics": ("post_date",),
}


def in_reading_order(mart: DataFrame, name: str) -> DataFrame:
    """A mart sorted the way its readers expect."""
    first, *ties = MART_ORDER[name]
    return mart.orderBy(F.col(first).desc(), *ties)

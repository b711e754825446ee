"""Trends, baselines and alerts over labelled posts, and the quality of a scorer.

Posts are reduced to counts per (date, label) or (date, subreddit) by hash aggregates; windows
run over these counts only, partitioned by label or subreddit, or over one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.filters import day_of
from hearsay.functions.numbers import avg_confidence

PLACES = 6


def _rows() -> Column:
    return F.count(F.lit(1))


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def subreddit_baseline(gold: DataFrame) -> DataFrame:
    """Net sentiment per subreddit and day against the subreddit's own past.

    ``net`` is (positive - negative) / posts of the day. ``baseline`` is the mean of the earlier
    days' ``net``, ``deviation`` the distance from it in their standard deviations; both are NULL
    without enough earlier days, and the deviation also where these do not vary.
    """
    days = gold.where(F.col("subreddit").isNotNull()).groupBy(
        "subreddit", day_of(gold).alias("post_date")
    ).agg(
        _rows().alias("posts"),
        (F.count_if(F.col("sentiment") == "positive")
         - F.count_if(F.col("sentiment") == "negative")).alias("_net"),
    )
    past = (Window.partitionBy("subreddit").orderBy("post_date")
            .rowsBetween(Window.unboundedPreceding, -1))
    net = _share(F.col("_net"), F.col("posts"))
    spread = F.stddev_samp(net).over(past)
    mean = F.avg(net).over(past)
    return days.select(
        "subreddit", "post_date", "posts", F.round(net, PLACES).alias("net"),
        F.round(mean, PLACES).alias("baseline"),
        F.when(spread > 1e-9, F.round((net - mean) / spread, PLACES)).alias("deviation"),
    )


def emotion_trend(gold: DataFrame, days: int = 7) -> DataFrame:
    """Posts per date and emotion, the change from the emotion's previous date, and the moving
    average over its last ``days`` dates."""
    counts = gold.where(F.col("emotion").isNotNull()).groupBy(
        day_of(gold).alias("post_date"), "emotion"
    ).agg(_rows().alias("posts"))
    order = Window.partitionBy("emotion").orderBy("post_date")
    recent = order.rowsBetween(1 - days, Window.currentRow)
    return counts.select(
        "post_date", "emotion", "posts",
        (F.col("posts") - F.lag("posts").over(order)).alias("change"),
        F.round(_share(F.sum("posts").over(recent), F.count("posts").over(recent)), PLACES)
        .alias("moving_average"),
    )


def sentiment_alerts(gold: DataFrame, days: int = 7, limit: float = 2.0) -> DataFrame:
    """Share of negative posts per date, and whether it leaves the band of the ``days`` dates
    before: their mean plus or minus ``limit`` standard deviations. At least two earlier dates
    are needed. The window runs over one row per date."""
    shares = gold.where(F.col("created_at").isNotNull()).groupBy(
        day_of(gold).alias("post_date")
    ).agg(_rows().alias("posts"), F.count_if(F.col("sentiment") == "negative").alias("_negative"))
    before = Window.orderBy("post_date").rowsBetween(-days, -1)
    share = _share(F.col("_negative"), F.col("posts"))
    mean, spread = F.avg(share).over(before), F.stddev_samp(share).over(before)
    away = F.round(F.abs(share - mean) - F.lit(limit) * spread, PLACES)
    return shares.select(
        "post_date", "posts", F.round(share, PLACES).alias("negative_share"),
        F.round(mean, PLACES).alias("trailing_mean"), F.round(spread, PLACES).alias("trailing_stddev"),
        F.coalesce(away > 0, F.lit(False)).alias("alert"),
    )


def conversation_sentiment(turns: DataFrame) -> DataFrame:
    """Sentiment of labelled turns per conversation and role."""
    feelings = [F.count_if(F.col("sentiment") == s).alias(f"{s}_turns")
                for s in ("positive", "negative", "neutral")]
    return turns.groupBy("conv_id", "role").agg(
        _rows().alias("turns"), *feelings,
        avg_confidence("sentiment_confidence").alias("avg_sentiment_confidence"),
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) over the rows that have both."""
    known = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return known.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        _rows().alias("n"))


def scorer_quality(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label, from a confusion matrix. Undefined ratios
    are NULL."""
    sides = matrix.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.lit(1).alias("is_truth"), F.lit(0).alias("is_guess")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("is_truth"), F.lit(1).alias("is_guess")),
    )).alias("side"), "n", (F.col("truth") == F.col("predicted")).alias("hit"))
    per = sides.groupBy("side.label").agg(
        F.sum(F.when(F.col("hit") & (F.col("side.is_truth") == 1), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.col("n") * F.col("side.is_truth")).alias("support"),
        F.sum(F.col("n") * F.col("side.is_guess")).alias("guesses"),
    )
    f1 = _share(2 * F.col("hits"), F.col("support") + F.col("guesses"))
    return per.select(
        "label", "support", "hits",
        F.round(_share(F.col("hits"), F.col("guesses")), PLACES).alias("precision"),
        F.round(_share(F.col("hits"), F.col("support")), PLACES).alias("recall"),
        F.round(f1, PLACES).alias("f1"),
    )

"""Cleaning and flagging of posts. No shuffle: every operator here is a projection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions import text as T

TEXT_COLUMNS = (
    "author", "subreddit", "title", "selftext", "url", "link_flair_text", "author_flair_text",
)


def standardize(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """Trim spaces from the text columns that are present."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.trim(F.col(c)) for c in present})


def flag_bots(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``is_bot``. ``strict`` asks for whole words, so "robot" is no bot."""
    return df.withColumn("is_bot", T.is_bot(F.col("author"), strict))


def flag_spam(df: DataFrame) -> DataFrame:
    """Add the three spam indicators; one post can carry several."""
    return df.withColumns({
        "has_char_spam": T.has_char_run(F.col("title")),
        "excessive_special_chars": T.has_many_special_chars(F.col("title")),
        "suspiciously_high_score": T.has_high_score(F.col("score")),
    })


def stamp_load(df: DataFrame, at: datetime | None = None) -> DataFrame:
    """Add the load time; ``at`` fixes it for repeatable runs."""
    return df.withColumn("load_date", F.current_timestamp() if at is None else F.lit(at))

"""Names and defaults shared by sources, sinks and plans."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

#: Parquet options of everything that holds texts: two thirds of the bytes of the default codec.
COMPACT = {"compression": "zstd"}

LAYERS = {
    "bronze": "posts_bronze",
    "silver": "posts_silver",
    "gold": "posts_gold",
    "progress": "load_progress",
    "run_metrics": "run_metrics",
    "post_states": "post_states",
    "author_states": "author_states",
    "author_numbers": "author_numbers",
    "topic_subreddits": "mv_topic_subreddits",
}

MARTS = {
    "sentiment_by_subreddit": "mv_sentiment_by_subreddit",
    "topic_trends": "mv_topic_trends",
    "emotion_analysis": "mv_emotion_analysis",
    "daily_metrics": "mv_daily_metrics",
}


@dataclass(frozen=True)
class Settings:
    """One namespace holds every layer, so writers and readers cannot drift apart."""

    namespace: str = "hearsay"
    comment: str = "Daily top posts, cleaned, labelled and summarised"
    posts_per_day: int = 100
    start: date = date(2024, 7, 1)
    retain_months: bool = True
    #: Layers and marts as views of generations, so that a rewrite is one switch for readers.
    generations: bool = False
    #: Buckets by id of the stored silver and gold; 0 stores them without.
    buckets: int = 0

    def table(self, name: str) -> str:
        """Qualified table name of a layer or a mart."""
        return f"{self.namespace}.{LAYERS.get(name) or MARTS[name]}"

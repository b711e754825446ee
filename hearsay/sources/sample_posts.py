"""Posts derived from the ``events`` and ``documents`` test tables.

One event is one post; its text is the document whose number is the event's number modulo the
number of documents. The mapping plants the cases the operators care about: bots, padded names,
spam titles, missing titles, bodies and ``over_18`` marks, and a second, later copy of every
tenth post. ``FIXTURES.md`` lists the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.scoring.labels import (
    EMOTION_LABELS, FALLBACKS, SENTIMENT_LABELS, TOPIC_LABELS,
)
from hearsay.scoring.lexicon import LexiconScorer

# The prose of the test documents is invented, so real word lists would call nearly all of it
# neutral. These lists spread some of its common words over the labels instead.
PROSE_SENTIMENT = {
    "negative": "this und des are von from sich",
    "positive": "with by et les den du auf",
}
PROSE_EMOTION = {
    "anger": "by ein",
    "disgust": "dans das",
    "fear": "are les",
    "joy": "with et zu",
    "sadness": "from des mit",
    "surprise": "this und",
}
PROSE_TOPICS = (
    "tre sur", "sch ist", "eux los", "ier una", "tion del", "ment las", "ing par", "ly pour",
    "nd elle", "ble ung", "ea keit", "sh heit", "th ado", "ti ver", "ed qui",
)


def prose_scorers() -> tuple[LexiconScorer, ...]:
    """Scorers whose labels vary on the test documents."""
    topics = dict(zip(TOPIC_LABELS, PROSE_TOPICS))
    return (
        LexiconScorer(
            "sentiment", _split(PROSE_SENTIMENT, SENTIMENT_LABELS), FALLBACKS["sentiment"],
            bias={"neutral": 1.5},
        ),
        LexiconScorer(
            "emotion", _split(PROSE_EMOTION, EMOTION_LABELS), FALLBACKS["emotion"],
            bias={"neutral": 1.2},
        ),
        LexiconScorer("topic", _split(topics, TOPIC_LABELS), FALLBACKS["topic"]),
    )


def _split(words: dict[str, str], labels: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    return {label: tuple(words.get(label, "").split()) for label in labels}


#: Common words of the invented prose by language; the other languages share one list.
LANGUAGE_WORDS = {
    "en": {"negative": "this are from", "positive": "with by"},
    "de": {"negative": "und des von sich", "positive": "mit den auf"},
    "fr": {"negative": "des sur", "positive": "les et du"},
}
OTHER_WORDS = {"negative": "que por", "positive": "los una"}


def language_scorers() -> tuple[dict[str, LexiconScorer], LexiconScorer]:
    """A sentiment scorer per language, and the one for other languages."""
    def one(words: dict[str, str]) -> LexiconScorer:
        return LexiconScorer("sentiment", _split(words, SENTIMENT_LABELS), FALLBACKS["sentiment"],
                             bias={"neutral": 1.5})

    return {lang: one(words) for lang, words in LANGUAGE_WORDS.items()}, one(OTHER_WORDS)


def tone_of_documents() -> LexiconScorer:
    """A two-label word list for documents; the prose is invented, so it checks arithmetic only."""
    words = {"clean": ("with", "by", "et", "mit", "los"), "toxic": ("idiot", "scum", "this", "des")}
    return LexiconScorer("verdict", words, "clean", bias={"clean": 1.0})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sample_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts (the bronze layer) of one test scale; lazy, so unused columns are never read."""
    return posts_from(read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "documents"))


def posts_from(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Posts of any frame of events, batch or streaming. One scan of each table.

    Texts are spread by ``doc_id``: a small file is one large row group, which would leave all
    later work on its texts to one task. A sort-merge join needs the same exchange anyway. The
    number of partitions is the configured one: left to itself, adaptive execution would merge
    partitions by their size before the join multiplies the texts.
    """
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number_of_documents = documents.agg(F.count(F.lit(1))).scalar()
    posts = events.withColumn("doc_id", F.col("event_id") % number_of_documents).join(
        documents.select("doc_id", "text", "lang", "source").repartition(partitions, "doc_id"),
        "doc_id",
    )
    event, user = F.col("event_id"), F.col("user_id")
    named = F.concat(F.lit("robot_"), user.cast("string"))
    padded = F.concat(F.lit(" user_"), user.cast("string"), F.lit(" "))
    kind = F.col("event_type")
    # 0 is the post itself, 1 the later copy of every tenth one.
    copies = F.when(event % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return posts.select(
        event.cast("string").alias("id"),
        F.when(user % 25 == 0, "AutoModerator").when(user % 25 == 1, "[deleted]")
        .when(user % 25 == 2, named).otherwise(padded).alias("author"),
        F.concat(F.lit(" "), F.col("source")).alias("subreddit"),
        F.when(event % 50 == 7, F.lit("wow" + "!" * 12))
        .when(event % 97 == 3, F.lit(None).cast("string"))
        .otherwise(F.substring_index("text", "\n", 1)).alias("title"),
        F.when(event % 41 != 5, F.col("text")).alias("selftext"),
        F.round(F.col("value") * 1000).cast("bigint").alias("score"),
        F.get_json_object("props", "$.k").cast("bigint").alias("num_comments"),
        F.col("ts").alias("created_at"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
        .alias("created_utc"),
        F.concat(F.lit("https://example.com/r/"), F.col("source"), F.lit("/"),
                 event.cast("string")).alias("url"),
        F.when(kind == "error", True).when(kind == "signup", F.lit(None).cast("boolean"))
        .otherwise(False).alias("over_18"),
        kind.alias("link_flair_text"),
        F.upper("lang").alias("author_flair_text"),
        F.explode(copies).alias("_copy"),
    ).withColumns({
        "score": F.col("score") + F.col("_copy"),
        "load_date": F.expr("created_at + make_dt_interval(1 + _copy)"),
    }).drop("_copy")

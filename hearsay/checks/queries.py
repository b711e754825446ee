"""One query per operator, over the posts derived from the test tables.

Summaries narrow the posts to the columns they need before the latest copies are chosen;
queries that show whole posts keep all columns.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.checks import stored, streams
from hearsay.checks.tone import tone_scorer
from hearsay.functions.filters import chosen, on_day, safe_only
from hearsay.operators import explore as ex
from hearsay.operators import graph
from hearsay.operators import insights as ins
from hearsay.operators import marts as m
from hearsay.operators import quality as q
from hearsay.operators.clean import flag_bots, flag_spam, standardize
from hearsay.operators.topk import top_per_group, top_rows
from hearsay.plans.layers import build_gold, build_silver, label_then_dedup, score_then_dedup
from hearsay.functions.numbers import avg_confidence
from hearsay.scoring import enrich
from hearsay.scoring.fitted import fit_best, load_model, save_model
from hearsay.scoring.word_table import learn_words, score_words
from hearsay.session import shared_scratch
from hearsay.scoring.enrich import enrich_by_language, enrich_topics
from hearsay.sources.sample_posts import (
    language_scorers, prose_scorers, read_table, sample_posts, tone_of_documents,
)
from hearsay.sources.tables import stage_gold

Query = Callable[[SparkSession, str], DataFrame]

LOAD_DAY = date(2024, 1, 10)
FIRST, LAST, SOME_SUBREDDITS = stored.FIRST, stored.LAST, stored.SOME_SUBREDDITS
POSTS_PER_DAY = 100
#: Least similarity of two subreddits; the test posts give most of them most authors.
ALIKE = Fraction(19, 20)
PAGE, FEW = 100, 10
VERDICTS = ("clean", "toxic")

LABELS = tuple(s.name for s in prose_scorers())
LABEL_COLUMNS = tuple(c for name in LABELS for c in (name, f"{name}_confidence"))


def _by_score() -> list:
    return [F.col("score").desc_nulls_last(), F.col("id").asc()]


def _bronze(spark: SparkSession, sf: str) -> DataFrame:
    return sample_posts(spark, sf)


def _silver(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return build_silver(_bronze(spark, sf), columns or None)


def _gold(spark: SparkSession, sf: str, *columns: str, where=None) -> DataFrame:
    """Chosen gold columns with only the scorers they need."""
    scorers = [s for s in prose_scorers() if {s.name, f"{s.name}_confidence"} & set(columns)]
    return label_then_dedup(_bronze(spark, sf), columns, scorers, where)


def _day(spark: SparkSession, sf: str) -> DataFrame:
    day = _bronze(spark, sf).transform(safe_only).transform(on_day, LOAD_DAY)
    return top_rows(day, _by_score(), POSTS_PER_DAY)


def _on_bronze(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(_bronze(spark, sf))


def _on_silver(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf: operator(_silver(spark, sf, *columns))


def _on_gold(operator: Callable[[DataFrame], DataFrame], *columns: str, where=None) -> Query:
    return lambda spark, sf: operator(_gold(spark, sf, *columns, where=where))


def _ranked(page: DataFrame, by: str) -> DataFrame:
    """A page with its order as a column; the window runs over the rows of one page."""
    order = Window.orderBy(F.col(by).desc_nulls_last(), "id")
    return page.withColumn("place", F.row_number().over(order))


def _few_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The first posts by id, chosen before their copies are ranked and before they are scored."""
    columns = ("title", "selftext", "score")
    silver = build_silver(ex.rows_of_first(_bronze(spark, sf), FEW), ("id", *columns))
    few = ex.sample_rows(silver, columns, FEW)
    return enrich(few, prose_scorers()).select("id", "title", "score", *LABEL_COLUMNS)


def _cleaned(bronze: DataFrame) -> DataFrame:
    return bronze.transform(standardize).transform(flag_bots)


def _labels_only(posts: DataFrame) -> DataFrame:
    return posts.select("id", *LABEL_COLUMNS)


def _enriched_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return _gold(spark, sf, "id", "sentiment", "sentiment_confidence")


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    return stage_gold(build_gold(_silver(spark, sf), prose_scorers()))


def _model_scored(spark: SparkSession, sf: str) -> DataFrame:
    scored = score_then_dedup(
        _bronze(spark, sf), ("id", "title", "selftext"),
        lambda posts: enrich(posts, [tone_scorer()], keep_errors=True),
        ("id", "tone", "tone_confidence", "tone_error"))
    return scored.select(
        "id", "tone", F.round("tone_confidence", 6).alias("tone_confidence"), "tone_error"
    )


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations").select(
        "conv_id", "role", F.col("text").alias("title"), F.lit(None).cast("string").alias("selftext"))
    return ins.conversation_sentiment(enrich(turns, prose_scorers()[:1]))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").withColumns(
        {"title": F.col("text"), "selftext": F.lit(None).cast("string")})


def _by_language(spark: SparkSession, sf: str) -> DataFrame:
    scored = enrich_by_language(_documents(spark, sf), "lang", *language_scorers())
    return scored.groupBy("lang", "sentiment").agg(
        F.count(F.lit(1)).alias("documents"), avg_confidence("sentiment_confidence").alias("avg_confidence"))


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    scored = enrich(_documents(spark, sf).select("doc_id", "title", "selftext"), [tone_of_documents()])
    truth = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    marked = scored.join(read_table(spark, sf, "labels").select("doc_id", truth.alias("truth")), "doc_id")
    return ins.confusion(marked, "truth", "verdict")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their truth and fold; the fold that is held out learns nothing."""
    truth = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    labels = read_table(spark, sf, "labels").select("doc_id", truth.alias("truth"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return read_table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id").withColumn("held_out", held)


#: Folders of the models of this process, by session and scale.
_MODELS: dict[tuple[str, str], str] = {}


def _fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of a model fitted to four folds, on the fifth, which took no part in choosing the penalty
    either; the model goes through its table. One fit serves all queries of a session and scale."""
    marked, key = _marked(spark, sf), (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        path = shared_scratch(spark, "model")
        model, _ = fit_best(marked.where("NOT held_out"), "text", F.col("truth") == "toxic", "verdict", VERDICTS)
        save_model(spark, model, path)
        _MODELS[key] = path
    path = _MODELS[key]
    return load_model(spark, path).score(marked.where("held_out"), "text")


def _toxic_words(spark: SparkSession, sf: str) -> DataFrame:
    return learn_words(_marked(spark, sf).where("length(text) % 5 <> 0"), "doc_id", "text", "truth")


def _by_word_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, by a table of words learned from some of the marked ones."""
    words, path = _toxic_words(spark, sf), shared_scratch(spark, "words")
    words.write.parquet(path)
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    scored = score_words(docs, "doc_id", "text", spark.read.parquet(path), VERDICTS, "clean", "verdict")
    return scored.select("doc_id", "verdict", "verdict_confidence")


def _subreddit_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topic lists made of every label but those of one third of the numbers, by subreddit."""
    topics = prose_scorers()[2]
    names = read_table(spark, sf, "documents").select("source").distinct().where("source <> 'src7'")
    number = F.expr("cast(substring(source, 4) as int)")
    labels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("label"))
                       for i, x in enumerate(topics.labels)])
    choices = (names.select(F.col("source").alias("subreddit"), number.alias("number"), F.explode(labels).alias("t"))
               .where("(number + t.i) % 3 <> 0").select("subreddit", "t.label"))
    return score_then_dedup(
        _bronze(spark, sf), ("id", "subreddit", "title", "selftext"),
        lambda posts: enrich_topics(posts, choices, topics),
        ("id", "subreddit", "topic", "topic_confidence"))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return graph.memberships(_silver(spark, sf, "subreddit", "author"))


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    return graph.similar_subreddits(_members(spark, sf), ALIKE)


def _listed(mart: DataFrame) -> DataFrame:
    """Topic trends with the array written as text, which every result reader compares alike."""
    return mart.withColumn("related_subreddits", F.array_join("related_subreddits", ","))


def _label_kind(kind: str) -> Query:
    return _on_gold(lambda g: m.label_distribution(g, kind), kind, f"{kind}_confidence")


SUBREDDIT_MART = (
    "subreddit", "score", "num_comments", "sentiment", "sentiment_confidence",
)
TOPIC_MART = (
    "subreddit", "score", "num_comments", "sentiment", "sentiment_confidence", "topic",
    "topic_confidence",
)
EMOTION_MART = ("score", "num_comments", "sentiment", "emotion", "emotion_confidence")
DAILY_MART = (
    "created_at", "subreddit", "author", "score", "num_comments", "sentiment",
    "sentiment_confidence", "emotion_confidence", "topic", "topic_confidence",
)
KPI = ("created_at", "subreddit", "author", "score", "num_comments")
PAGE_OF = (
    "id", "subreddit", "author", "title", "score", "num_comments", "created_at", "url",
)


def _page(**options) -> Query:
    return _on_silver(lambda s: ex.explore(s, limit=PAGE, **options), *PAGE_OF)


def _batch_queries() -> dict[str, Query]:
    return {
        # layers
        "posts_bronze": _on_bronze(lambda b: b),
        "standardized_posts": _on_bronze(standardize),
        "posts_silver": _on_silver(lambda s: s),
        "posts_staged": _staged,
        # loading
        "safe_posts": _on_bronze(lambda b: safe_only(b).select("id", "over_18", "load_date")),
        "daily_top_posts": _day,
        "top_posts_per_day": lambda spark, sf: top_per_group(
            _bronze(spark, sf).transform(safe_only)
            .withColumn("load_day", F.to_date("created_at")),
            ["load_day"], _by_score(), POSTS_PER_DAY,
        ),
        "load_summary": lambda spark, sf: m.load_summary(_day(spark, sf)),
        "load_top_subreddits": lambda spark, sf: m.most_frequent_subreddits(_day(spark, sf)),
        "bronze_summary": _on_bronze(m.bronze_summary),
        # quality
        "bot_flags": _on_bronze(
            lambda b: _cleaned(b).select("id", "load_date", "author", "is_bot")
        ),
        "strict_bot_flags": _on_bronze(
            lambda b: flag_bots(standardize(b), strict=True)
            .select("id", "load_date", "author", "is_bot")
        ),
        "spam_flags": _on_bronze(
            lambda b: flag_spam(standardize(b)).select(
                "id", "load_date", "title", "has_char_spam", "excessive_special_chars",
                "suspiciously_high_score",
            )
        ),
        "null_report": _on_bronze(lambda b: q.null_report(_cleaned(b))),
        "spam_report": _on_bronze(lambda b: q.spam_report(_cleaned(b))),
        "bot_report": _on_bronze(lambda b: q.bot_report(_cleaned(b))),
        "dedup_report": _on_bronze(q.dedup_report),
        "quality_summary": _on_bronze(lambda b: q.quality_summary(_cleaned(b))),
        "silver_metrics": _on_silver(
            q.silver_metrics, "id", "author", "subreddit", "created_at", "is_bot"
        ),
        # scoring
        "enrich_sentiment": _enriched_sentiment,
        "enrich_gold": _on_gold(_labels_only, "id", *LABEL_COLUMNS),
        "model_scores": _model_scored,
        # marts
        "sentiment_by_subreddit": _on_gold(m.sentiment_by_subreddit, *SUBREDDIT_MART),
        "topic_trends": _on_gold(lambda g: _listed(m.topic_trends(g)), *TOPIC_MART),
        "emotion_analysis": _on_gold(m.emotion_analysis, *EMOTION_MART),
        "daily_metrics": _on_gold(m.daily_metrics, *DAILY_MART),
        "sentiment_distribution_confidence": _label_kind("sentiment"),
        "emotion_distribution_confidence": _label_kind("emotion"),
        "topic_distribution_confidence": _label_kind("topic"),
        "label_metric_keys": _on_gold(m.label_metrics, *LABELS),
        "sentiment_heatmap": _on_gold(m.sentiment_heatmap, "subreddit", "sentiment"),
        "emotion_by_subreddit": _on_gold(
            m.emotion_by_subreddit, "subreddit", "emotion", "emotion_confidence"
        ),
        "topics_over_time": _on_gold(m.topics_over_time, "created_at", "topic"),
        "topic_scores": _on_gold(m.topic_scores, "topic", "score"),
        "top_subreddit_sentiment": _on_gold(
            lambda g: m.top_subreddit_sentiment(m.sentiment_by_subreddit(g)), *SUBREDDIT_MART
        ),
        "topics_by_posts": _on_gold(
            lambda g: m.topics_by_posts(m.topic_trends(g)), *TOPIC_MART
        ),
        "daily_sentiment": _on_gold(
            lambda g: m.daily_sentiment(m.daily_metrics(g)), *DAILY_MART
        ),
        # insights
        "subreddit_baseline": _on_gold(
            ins.subreddit_baseline, "subreddit", "created_at", "sentiment"),
        "emotion_trend": _on_gold(ins.emotion_trend, "created_at", "emotion"),
        "sentiment_alerts": _on_gold(ins.sentiment_alerts, "created_at", "sentiment"),
        "conversation_sentiment": _conversations,
        "lang_sentiment": _by_language,
        "confusion_matrix": _confusion,
        "scorer_quality": lambda spark, sf: ins.scorer_quality(_confusion(spark, sf)),
        "fitted_verdicts": lambda spark, sf: _fitted(spark, sf).select("doc_id", "verdict", "verdict_confidence"),
        "fitted_quality": lambda spark, sf: ins.scorer_quality(
            ins.confusion(_fitted(spark, sf), "truth", "verdict")),
        "learned_words": _toxic_words,
        "word_table_verdicts": _by_word_table,
        "subreddit_topics": _subreddit_topics,
        "subreddit_similarity": _similar,
        "subreddit_graph": lambda spark, sf: graph.subreddit_graph(
            _members(spark, sf), graph.kept(_similar(spark, sf), "edges")),
        "author_degrees": lambda spark, sf: graph.author_degrees(_members(spark, sf)),
        # exploration
        "kpis": _on_silver(ex.kpis, *KPI),
        "kpis_filtered": _on_silver(lambda s: ex.kpis(s, FIRST, LAST, SOME_SUBREDDITS), *KPI),
        "daily_trends": _on_silver(ex.daily_trends, "created_at", "subreddit", "score",
                                   "num_comments"),
        "daily_trends_filtered": _on_silver(
            lambda s: ex.daily_trends(s, FIRST, LAST, SOME_SUBREDDITS),
            "created_at", "subreddit", "score", "num_comments",
        ),
        "top_subreddits": _on_silver(
            lambda s: ex.top_subreddits(s, FIRST, LAST), "created_at", "subreddit", "score"
        ),
        "dominant_sentiment": _on_gold(
            lambda g: ex.dominant_sentiment(g, FIRST, LAST),
            "created_at", "subreddit", "sentiment", where=lambda b: chosen(b, FIRST, LAST),
        ),
        "sentiment_distribution": _on_gold(
            lambda g: ex.distribution(g, "sentiment", FIRST, LAST, SOME_SUBREDDITS),
            "created_at", "subreddit", "sentiment",
            where=lambda b: chosen(b, FIRST, LAST, SOME_SUBREDDITS),
        ),
        "emotion_distribution": _on_gold(
            lambda g: ex.distribution(g, "emotion", FIRST, LAST, ["All Subreddits"], k=10),
            "created_at", "subreddit", "emotion", where=lambda b: chosen(b, FIRST, LAST),
        ),
        "topic_distribution": _on_gold(
            lambda g: ex.distribution(g, "topic", FIRST, LAST, k=10),
            "created_at", "subreddit", "topic", where=lambda b: chosen(b, FIRST, LAST),
        ),
        "available_dates": _on_silver(ex.available_dates, "created_at"),
        "available_subreddits": _on_silver(ex.available_subreddits, "subreddit"),
        "explore_recent": _page(),
        "explore_filtered": _page(start=FIRST, end=LAST, subreddits=SOME_SUBREDDITS),
        "explore_page_by_score": lambda spark, sf: _ranked(
            _page(sort="score")(spark, sf), "score"),
        "explore_page_by_comments": lambda spark, sf: _ranked(
            _page(sort="comments")(spark, sf), "num_comments"),
        "explore_all_by_score": _page(sort="score", sort_scope="all"),
        "confident_negative": _on_gold(
            ex.confident_posts, "id", "title", "score", "sentiment", "sentiment_confidence"
        ),
        "confident_negative_top10": _on_gold(
            lambda g: ex.confident_posts(g, limit=10),
            "id", "title", "score", "sentiment", "sentiment_confidence",
        ),
        "sample_posts": _on_silver(
            lambda s: ex.sample_rows(s, ("author", "subreddit", "title", "score"), 5),
            "id", "author", "subreddit", "title", "score",
        ),
        "sample_labelled_posts": _few_labelled,
    }


def queries() -> dict[str, Query]:
    """Name to query."""
    return _batch_queries() | stored.queries() | {
        "stream_dedup": streams.stream_dedup,
        "stream_silver": streams.stream_silver,
        "stream_daily": streams.stream_daily,
        "stream_closed_days": streams.stream_closed_days,
    }


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Daily metrics of labelled posts."""
    return queries()["daily_metrics"](spark, sf)

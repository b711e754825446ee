"""Round trips through stored tables: load, refresh, marts, run metrics, CSV.

Each goes through a namespace of its own; what it leaves is copied to the shared scratch folder
and the namespace is dropped. One build serves all queries of a session and scale, but for those that
return whole posts: only they copy them. A layer is dropped as soon as no later step reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.config import COMPACT, MARTS, Settings
from hearsay.functions.filters import post_date
from hearsay.operators.explore import daily_trends
from hearsay.operators.rounds import rounds_for
from hearsay.operators.states import BUILDERS
from hearsay.plans.daily_load import run_day, run_range
from hearsay.plans.incremental import read_kpis, refresh_dates
from hearsay.plans.layers import build_silver
from hearsay.plans.refresh import read_mart, refresh_gold, refresh_marts, refresh_silver
from hearsay.session import path_exists, shared_scratch
from hearsay.sinks.tables import drop_layer, ensure_namespace, export_csv, replace_dates, write_layer
from hearsay.sources.sample_posts import prose_scorers, sample_posts
from hearsay.sources.tables import read_layer, stage_gold

POSTS_PER_DAY = 100
#: Days by which posts are moved so that they cross the end of a month.
MOVED = 2
FIRST, LAST = date(2024, 1, 5), date(2024, 1, 24)
SOME_SUBREDDITS = ("src1", "src2", "src3", "src5", "src8", "src13")
Build = Callable[[SparkSession, str, str], None]
_PLACES: dict[tuple[str, str, str], str] = {}


@contextmanager
def _namespace(spark: SparkSession, **options) -> Iterator[Settings]:
    settings = Settings(namespace=f"check_{uuid.uuid4().hex}", **options)
    ensure_namespace(spark, settings)
    try:
        yield settings
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {settings.namespace} CASCADE")


def _load(spark: SparkSession, sf: str, base: str) -> None:
    """Raw posts in folders of one month each, loaded as one range."""
    raw = sample_posts(spark, sf).drop("load_date")
    months = raw.select(F.date_trunc("month", "created_at").cast("date").alias("m")).distinct().collect()
    for (month,) in months:
        inside = F.col("created_at").between(F.lit(month), F.add_months(F.lit(month), 1))
        raw.where(inside & (F.month("created_at") == month.month)).write.options(**COMPACT).parquet(
            f"{base}/raw/{month.year}/{month.month:02d}")
    first, last = raw.agg(F.min(F.to_date("created_at")), F.max(F.to_date("created_at"))).first()
    with _namespace(spark, posts_per_day=POSTS_PER_DAY, start=first) as s:
        run_range(spark, s, f"{base}/raw", first + timedelta(days=9))
        run_range(spark, s, f"{base}/raw", last)
        read_layer(spark, s, "bronze").write.options(**COMPACT).parquet(f"{base}/bronze")
        read_layer(spark, s, "progress").write.parquet(f"{base}/progress")


def _month_end(spark: SparkSession, sf: str, base: str) -> None:
    """Day by day over the end of a month that bronze does not keep: raw posts moved by two days."""
    raw = sample_posts(spark, sf).drop("load_date").withColumns({
        "created_at": F.col("created_at") + F.expr(f"INTERVAL {MOVED} DAY"), "created_utc": F.col("created_utc") + MOVED * 86400})
    for month in (1, 2):
        raw.where(F.month("created_at") == month).write.options(**COMPACT).parquet(f"{base}/raw/2024/{month:02d}")
    with _namespace(spark, posts_per_day=POSTS_PER_DAY, start=date(2024, 1, 30), retain_months=False) as s:
        for n in range(3):
            run_day(spark, s, f"{base}/raw", at=datetime(2024, 3, 1, n))
            read_layer(spark, s, "bronze").withColumn("run", F.lit(n)).write.mode("append").parquet(f"{base}/bronze")
        read_layer(spark, s, "progress").write.parquet(f"{base}/progress")


def _edits(spark: SparkSession, sf: str, base: str) -> None:
    """Gold in generations: built from posts of which some are later edited, then rescored where they
    changed."""
    posts = sample_posts(spark, sf)
    number = F.col("id").cast("long")
    before = posts.where(number % 9 != 0).withColumns({
        "selftext": F.when(number % 7 == 0, F.lit("with by et les")).otherwise(F.col("selftext")),
        "score": F.when(number % 5 == 0, F.col("score") + 1).otherwise(F.col("score"))})
    with _namespace(spark, generations=True) as s:
        for rows in (before, posts):
            write_layer(rows, s, "bronze")
            refresh_silver(spark, s)
            drop_layer(spark, s, "bronze")
            refresh_gold(spark, s, prose_scorers(), run_id="edits", only_changed=True)
            drop_layer(spark, s, "silver")
        stage_gold(read_layer(spark, s, "gold")).write.options(**COMPACT).parquet(f"{base}/rescored_gold")


def _refresh(spark: SparkSession, sf: str, base: str, gold_too: bool = False) -> None:
    """Bronze to silver, gold, marts and run metrics; ``gold_too`` copies the posts of gold as well."""
    with _namespace(spark, start=date(2024, 1, 1)) as s:
        write_layer(sample_posts(spark, sf), s, "bronze")
        silver = refresh_silver(spark, s)
        drop_layer(spark, s, "bronze")
        gold = refresh_gold(spark, s, prose_scorers(), cluster_by=("subreddit",), run_id="check")
        refresh_marts(spark, s)
        silver.unionByName(gold).write.parquet(f"{base}/write_check")
        drop_layer(spark, s, "silver")
        if gold_too:
            stage_gold(read_layer(spark, s, "gold")).write.options(**COMPACT).parquet(f"{base}/gold")
        read_layer(spark, s, "run_metrics").write.parquet(f"{base}/run_metrics")
        for mart in MARTS:
            read_mart(spark, s, mart).write.parquet(f"{base}/{mart}")


def _refreshed_gold(spark: SparkSession, sf: str, base: str) -> None:
    _refresh(spark, sf, base, gold_too=True)


def _increments(spark: SparkSession, sf: str, base: str, gold_too: bool = False) -> None:
    """Marts from states after a first build, a corrected day, two new days and one that vanished. Bronze
    keeps dates apart, so only these dates of it are written again; ``gold_too`` copies the posts of gold."""
    posts = sample_posts(spark, sf)
    day = F.to_date("created_at")
    first, last = posts.agg(F.min(day), F.max(day)).first()
    wrong, gone, late = first + timedelta(days=3), last + timedelta(days=1), last - timedelta(days=1)
    early = posts.where(day < F.lit(late)).withColumns({
        "score": F.when(day == F.lit(wrong), F.col("score") + 77).otherwise(F.col("score")),
        "author": F.when(day == F.lit(wrong), F.lit("somebody else")).otherwise(F.col("author"))})
    moved = posts.where(day == F.lit(wrong)).withColumns({
        "id": F.concat(F.lit("x"), "id"), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY") * (gone - wrong).days,
        "created_utc": F.col("created_utc") + 86400 * (gone - wrong).days})
    changed = [wrong, late, last, gone]
    with _namespace(spark) as s:
        before = early.unionByName(moved).withColumn("post_date", post_date())
        replace_dates(before, s, "bronze", None, rounds=rounds_for(before))
        refresh_dates(spark, s, None, prose_scorers())
        corrected = posts.where(day.isin(changed)).withColumn("post_date", post_date())
        replace_dates(corrected, s, "bronze", changed)
        refresh_dates(spark, s, changed, prose_scorers())
        for layer in ("bronze", "silver"):
            drop_layer(spark, s, layer)
        if gold_too:
            stage_gold(read_layer(spark, s, "gold")).write.options(**COMPACT).parquet(f"{base}/gold")
        for mart in BUILDERS:
            read_layer(spark, s, mart).write.parquet(f"{base}/{mart}")
        read_kpis(spark, s).write.parquet(f"{base}/kpis")
        read_kpis(spark, s, FIRST, LAST, SOME_SUBREDDITS).write.parquet(f"{base}/kpis_filtered")


def _incremented_gold(spark: SparkSession, sf: str, base: str) -> None:
    _increments(spark, sf, base, gold_too=True)


def _place(spark: SparkSession, sf: str, build: Build) -> str:
    key = (spark.sparkContext.applicationId, sf, build.__name__)
    if key not in _PLACES or not path_exists(spark, _PLACES[key]):
        base = shared_scratch(spark, f"stored{build.__name__}")
        build(spark, sf, base)
        _PLACES[key] = base
    return _PLACES[key]


def _read(build: Build, table: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = spark.read.parquet(f"{_place(spark, sf, build)}/{table}")
        return df.select(*columns) if columns else df

    return query


def _bronze(spark: SparkSession, sf: str) -> DataFrame:
    return _read(_load, "bronze")(spark, sf).drop("load_date")


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    mart = _read(_refresh, "topic_trends")(spark, sf)
    return mart.withColumn("related_subreddits", F.array_join("related_subreddits", ","))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _read(_refresh, "run_metrics")(spark, sf).where("kind = 'metric'").select("run_id", "key", "value")


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Daily trends written as CSV and read back."""
    posts = build_silver(sample_posts(spark, sf), ("created_at", "subreddit", "score", "num_comments"))
    trends, path = daily_trends(posts), f"{shared_scratch(spark, 'csv')}/trends"
    export_csv(trends, path)
    return spark.read.schema(trends.schema).option("header", True).csv(path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {
        "range_load_bronze": _bronze,
        "range_load_state": _read(_load, "progress", "year", "month", "day"),
        "stored_gold": _read(_refreshed_gold, "gold"),
        "rescored_gold": _read(_edits, "rescored_gold"),
        "month_end_bronze": _read(_month_end, "bronze"),
        "month_end_state": _read(_month_end, "progress", "year", "month", "day"),
        "stored_sentiment_by_subreddit": _read(_refresh, "sentiment_by_subreddit"),
        "stored_topic_trends": _topics,
        "stored_emotion_analysis": _read(_refresh, "emotion_analysis"),
        "stored_daily_metrics": _read(_refresh, "daily_metrics"),
        "run_metrics": _metrics,
        "write_check": _read(_refresh, "write_check"),
        "csv_round_trip": csv_round_trip,
        "incremental_gold": _read(_incremented_gold, "gold"),
        **{f"incremental_{mart}": _read(_increments, mart) for mart in BUILDERS},
        "kpis_from_states": _read(_increments, "kpis"),
        "kpis_filtered_from_states": _read(_increments, "kpis_filtered"),
    }

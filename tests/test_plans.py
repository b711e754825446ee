"""Physical plans: what is read, what is shuffled, what runs in Python."""

import re

import pytest
from pyspark.sql import functions as F

from hearsay.checks.queries import FIRST, LAST, queries
from hearsay.functions.filters import between_days, on_day, safe_only
from hearsay.scoring import enrich
from hearsay.sinks.tables import laid_out
from hearsay.sources.sample_posts import prose_scorers, sample_posts
from hearsay.sources.tables import STAGED_COLUMNS, stage_gold
from tests.compare import spark_rows

BATCH = sorted(n for n in queries() if not n.startswith("stream"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_keyless_pairs_and_no_needless_python(spark, sf_dir, name):
    plan = _plan(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan) == (name == "model_scores")


@pytest.mark.parametrize("name", ["kpis", "daily_trends", "top_subreddits", "dedup_report",
                                  "available_dates", "bronze_summary", "silver_metrics"])
def test_summaries_without_labels_do_not_read_texts(spark, sf_dir, name):
    plan = _plan(queries()[name](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and not any("text" in s for s in schemas)


@pytest.mark.parametrize("name", ["sentiment_by_subreddit", "topic_trends", "daily_metrics",
                                  "emotion_analysis"])
def test_marts_do_not_shuffle_texts(spark, sf_dir, name):
    """Texts are scored before the latest copies are chosen, so that shuffle is narrow."""
    plan = _plan(queries()[name](spark, sf_dir))
    dedup = plan.split("Exchange hashpartitioning(id")[0]
    assert "_text" not in dedup and "selftext" not in dedup
    assert plan.count("WindowGroupLimit") == 2


def test_scoring_adds_no_shuffle_and_splits_texts_once(spark, sf_dir):
    posts = sample_posts(spark, sf_dir)
    plan = _plan(enrich(posts, prose_scorers()).drop("load_date"))
    assert plan.count("Exchange") == _plan(posts.drop("load_date")).count("Exchange")
    assert plan.count("split(lower(") == 1


def test_filters_reach_the_scan(spark, tmp_path, sf_dir):
    path = f"{tmp_path}/posts"
    sample_posts(spark, sf_dir).write.parquet(path)
    posts = spark.read.parquet(path)
    days = _plan(between_days(posts, FIRST, LAST).select("id"))
    pushed = days.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(created_utc" in pushed and "LessThan(created_utc" in pushed
    safe = _plan(posts.transform(safe_only).transform(on_day, FIRST).select("id"))
    pushed = safe.split("PushedFilters:")[1]
    assert "IsNotNull(created_utc)" in pushed and "IsNull(over_18)" in pushed


def test_top_k_limits_before_the_shuffle(spark, sf_dir):
    plan = _plan(queries()["top_posts_per_day"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") == 4
    assert plan.count("Partial") == 2


def test_reports_read_posts_once(spark, sf_dir):
    """The other reads are counts of documents, which need no column."""
    plan = _plan(queries()["quality_summary"](spark, sf_dir))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]+)>", plan))
    assert len([s for s in schemas if "event_id" in s]) == 1
    assert len([s for s in schemas if "doc_id" in s]) == 1


def test_small_groups_are_all_that_is_gathered(spark, sf_dir):
    """Window.partitionBy() with no key appears over per-emotion rows only."""
    plan = _plan(queries()["emotion_analysis"](spark, sf_dir))
    gathered = plan.split("Exchange SinglePartition")
    assert len(gathered) >= 2
    assert "HashAggregate(keys=[emotion" in gathered[1]


def test_days_prune_a_layer_by_post_date(spark, tmp_path, sf_dir):
    path = f"{tmp_path}/gold"
    laid_out(sample_posts(spark, sf_dir), by_post_date=True).write.partitionBy("post_date").parquet(path)
    plan = _plan(between_days(spark.read.parquet(path), FIRST, LAST).select("id"))
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "post_date" in filters


def test_days_prune_the_staged_view_of_a_layer_by_post_date(spark, tmp_path, sf_dir):
    path = f"{tmp_path}/gold"
    extra = {c: F.lit(None).cast("string") for c in STAGED_COLUMNS if c not in sample_posts(spark, sf_dir).columns}
    laid_out(sample_posts(spark, sf_dir).withColumns(extra), by_post_date=True).write.partitionBy("post_date").parquet(path)
    gold = spark.read.parquet(path)
    stage_gold(gold, "dated_posts", dated=True)
    ranged = between_days(spark.table("dated_posts"), FIRST, LAST).select("id")
    assert "post_date" in _plan(ranged).split("PartitionFilters: [")[1].split("]")[0]
    assert spark_rows(ranged) == spark_rows(between_days(stage_gold(gold), FIRST, LAST).select("id"))
    assert stage_gold(gold).columns == stage_gold(gold.drop("post_date"), dated=True).columns == list(STAGED_COLUMNS)


def test_posts_outside_the_days_are_not_scored(spark, sf_dir):
    plan = _plan(queries()["dominant_sentiment"](spark, sf_dir))
    assert "THEN concat_ws(" in plan

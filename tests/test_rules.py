"""One hand-made row per rule."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hearsay.functions import text as T
from hearsay.functions.filters import (
    between_days, confident, in_subreddits, on_day, safe_only, utc_date,
)
from hearsay.operators import quality as q
from hearsay.operators.clean import flag_bots, flag_spam, stamp_load, standardize
from hearsay.operators.explore import available_dates, explore, kpis
from hearsay.operators.marts import daily_metrics, label_metrics, topic_trends


def _values(spark, values, kind, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


NAMES = ["AutoModerator", "[deleted]", "[removed]", "my_bot", "robot", "Abbott", "x[deleted]",
         "alice", None]


def test_bot_rule(spark):
    assert _values(spark, NAMES, "string", T.is_bot) == [
        True, True, True, True, True, True, False, False, False]


def test_strict_bot_rule(spark):
    assert _values(spark, NAMES, "string", lambda c: T.is_bot(c, strict=True)) == [
        True, True, True, True, False, False, False, False, False]


def test_char_run_rule(spark):
    values = ["a" * 11, "a" * 10, "\n" * 11, "xx" + "é" * 11, None]
    assert _values(spark, values, "string", T.has_char_run) == [True, False, False, True, False]


def test_special_char_rule(spark):
    values = ["!" * 11, "!" * 10, "?" * 20, "a!@#$%^&*()!b", None]
    assert _values(spark, values, "string", T.has_many_special_chars) == [
        True, False, False, True, False]


def test_high_score_rule(spark):
    assert _values(spark, [100001, 100000, None], "bigint", T.has_high_score) == [
        True, False, False]


def test_missing_rule(spark):
    assert _values(spark, [None, "", "  ", "\t", "x"], "string", T.is_missing) == [
        True, True, True, False, False]


def test_blank_rule(spark):
    values = [None, "", " ", "\n", "  ", "\x1c\x1f", " a "]
    assert _values(spark, values, "string", T.is_blank) == [
        True, True, True, True, True, True, False]


def test_metric_key(spark):
    assert _values(spark, ["Technology & Science"], "string",
                   lambda c: T.metric_key("topic", c)) == [
        "topic_Technology_and_Science_count"]


def test_combined_text(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None), (None, None)],
                               "title string, selftext string")
    assert [r[0] for r in df.select(T.combined_text()).collect()] == ["a b", " b", "a ", " "]


def test_safe_only(spark):
    df = spark.createDataFrame([(1, False), (2, None), (3, True)], "i int, over_18 boolean")
    assert sorted(r.i for r in safe_only(df).collect()) == [1, 2]


def test_on_day_bounds_are_utc(spark):
    start = 1720137600  # 2024-07-05 00:00:00 UTC
    df = spark.createDataFrame([(start - 1,), (start,), (start + 86399,), (start + 86400,)],
                               "created_utc bigint")
    kept = [r[0] for r in on_day(df, date(2024, 7, 5)).orderBy("created_utc").collect()]
    assert kept == [start, start + 86399]
    assert df.select(utc_date(F.col("created_utc"))).distinct().count() == 3


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_between_days_takes_both_timestamp_types(spark, kind):
    df = spark.createDataFrame(
        [(datetime(2024, 1, d, 23, 59, 59),) for d in (1, 2, 3, 4)], f"created_at {kind}")
    assert between_days(df, date(2024, 1, 2), date(2024, 1, 3)).count() == 2
    assert between_days(df, date(2024, 1, 2), None).count() == 3
    assert between_days(df, None, None).count() == 4


@pytest.mark.parametrize("chosen, expected", [
    ([], 3), (None, 3), (["All Subreddits"], 3), (["All Subreddits", "src1"], 3), (["src1"], 1),
    (["o'x"], 1), (["nope"], 0),
])
def test_subreddit_filter(spark, chosen, expected):
    df = spark.createDataFrame([("src1",), ("src2",), ("o'x",)], "subreddit string")
    assert in_subreddits(df, chosen).count() == expected


def test_confident_is_strictly_above(spark):
    df = spark.createDataFrame([("negative", 0.8), ("negative", 0.81), ("positive", 0.9)],
                               "sentiment string, sentiment_confidence double")
    assert [r[1] for r in confident(df, "negative", 0.8).collect()] == [0.81]


def test_standardize_trims_spaces_only(spark):
    df = spark.createDataFrame([("  a\t ", " b ")], "author string, other string")
    assert standardize(df).first() == ("a\t", " b ")


def test_stamp_load(spark):
    at = datetime(2024, 7, 2, 2)
    df = stamp_load(spark.range(1), at)
    assert df.first().load_date == at
    assert stamp_load(spark.range(1)).first().load_date is not None


def test_flag_columns(spark):
    df = spark.createDataFrame([("bot", "!" * 12, 5)], "author string, title string, score bigint")
    row = flag_spam(flag_bots(df)).first()
    assert (row.is_bot, row.has_char_spam, row.excessive_special_chars,
            row.suspiciously_high_score) == (True, True, True, False)


def test_schema_report(spark):
    df = spark.createDataFrame([], "id string, author string, title string, score int,"
                                   "created_at timestamp_ntz, over_18 boolean")
    report = {r.field: (r.actual, r.ok) for r in q.validate_schema(df).collect()}
    assert report["score"] == ("int", False)
    assert report["subreddit"] == (None, False)
    assert report["created_at"] == ("timestamp_ntz", True)
    assert report["id"] == ("string", True)
    with pytest.raises(TypeError, match="subreddit, score"):
        q.validate_schema(df, strict=True)


POSTS = ("id string, author string, subreddit string, title string, selftext string,"
         "score bigint, num_comments bigint, created_at timestamp_ntz, url string,"
         "is_bot boolean, sentiment string, sentiment_confidence double, emotion string,"
         "emotion_confidence double, topic string, topic_confidence double")


def test_reports_on_empty_input(spark):
    empty = spark.createDataFrame([], POSTS)
    assert q.null_report(empty).first().total_nulls == 0
    assert q.spam_report(empty).first().total_spam == 0
    bots = q.bot_report(empty).first()
    assert (bots.total_records, bots.bot_pct) == (0, None)
    assert tuple(q.dedup_report(empty).first()) == (0, 0, 0)
    assert q.silver_metrics(empty).first().total_records == 0
    k = kpis(empty).first()
    assert (k.total_posts, k.total_score, k.avg_score, k.engagement_rate) == (0, 0, None, 0.0)
    dates = available_dates(empty, date(2024, 3, 31)).first()
    assert tuple(dates) == (date(2024, 3, 1), date(2024, 3, 31))
    assert daily_metrics(empty).count() == 0
    assert {r.key: r.value for r in label_metrics(empty).collect()} == {}


def test_null_keys_count_once_in_dedup_report(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "id string")
    assert tuple(q.dedup_report(df).first()) == (4, 2, 2)


def test_topic_trends_lists_every_subreddit_once_in_order(spark):
    rows = [(s, "Gaming", 0.5) for s in ("b", "a", "b", None)]
    df = spark.createDataFrame(rows, "subreddit string, topic string, topic_confidence double")
    df = df.withColumns({
        "sentiment": F.lit("positive"), "sentiment_confidence": F.lit(0.25),
        "score": F.lit(3).cast("bigint"), "num_comments": F.lit(None).cast("bigint"),
    })
    row = topic_trends(df).first()
    assert row.related_subreddits == ["a", "b"]
    assert (row.post_count, row.positive_posts, row.avg_score, row.avg_comments) == (4, 4, 3.0,
                                                                                      None)


def test_explore_rejects_unknown_options(spark):
    df = spark.createDataFrame([], POSTS)
    with pytest.raises(ValueError):
        explore(df, sort="oldest")
    with pytest.raises(ValueError):
        explore(df, sort_scope="some")


def test_explore_page_scope(spark):
    rows = [(str(i), "s", "a", "t", 100 - i, i, datetime(2024, 1, 1 + i), "u") for i in range(9)]
    df = spark.createDataFrame(
        rows, "id string, subreddit string, author string, title string, score bigint,"
              "num_comments bigint, created_at timestamp_ntz, url string")
    recent = [r.id for r in explore(df, limit=3).collect()]
    page = [r.id for r in explore(df, limit=3, sort="score").collect()]
    everything = [r.id for r in explore(df, limit=3, sort="score", sort_scope="all").collect()]
    assert (recent, page, everything) == (["8", "7", "6"], ["6", "7", "8"], ["0", "1", "2"])

"""Daily load: state, day partitions, reruns and month ends."""

from datetime import date, datetime, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearsay.functions.filters import epoch
from hearsay.plans.daily_load import run_day, run_range
from hearsay.sinks.tables import (
    ensure_namespace, reset_month, write_progress,
)
from hearsay.sources.submissions import SUBMISSION_SCHEMA, months_between, read_submissions
from hearsay.sources.tables import Progress, layer_exists, read_layer, read_progress

AT = datetime(2024, 8, 1, 2, tzinfo=timezone.utc)


@pytest.mark.parametrize("day, following", [
    (date(2024, 7, 1), date(2024, 7, 2)),
    (date(2024, 7, 31), date(2024, 8, 1)),
    (date(2024, 12, 31), date(2025, 1, 1)),
    (date(2024, 2, 28), date(2024, 2, 29)),
    (date(2023, 2, 28), date(2023, 3, 1)),
])
def test_next_day(day, following):
    assert Progress(day).after().next_day == following


@given(st.dates(date(1990, 1, 1), date(2100, 1, 1)))
def test_next_day_always_grows(day):
    assert Progress(day).after().next_day > day


def test_months_between():
    assert months_between(date(2024, 11, 30), date(2025, 2, 1)) == [
        (2024, 11), (2024, 12), (2025, 1), (2025, 2)]


def _post(day, n, score, over_18=None):
    seconds = epoch(day) + n
    created = datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)
    return (f"{day}-{n}", "a", "s", "t", None, score, 0, created, seconds, "u", over_18, None,
            None)


@pytest.fixture
def root(spark, tmp_path):
    """Posts of 29 July to 2 August 2024; nothing on 30 July."""
    days = [date(2024, 7, 29), date(2024, 7, 31), date(2024, 8, 1), date(2024, 8, 2)]
    for month in (7, 8):
        rows = [
            _post(d, n, n % 7, None if n % 2 else False)
            for d in days if d.month == month for n in range(20)
        ] + [_post(d, 99, 1000, True) for d in days if d.month == month]
        spark.createDataFrame(rows, SUBMISSION_SCHEMA).write.parquet(
            f"{tmp_path}/raw/2024/{month:02d}")
    return f"{tmp_path}/raw"


def _small(settings, **changes):
    from dataclasses import replace
    return replace(settings, posts_per_day=5, start=date(2024, 7, 29), **changes)


def _days(spark, settings):
    rows = read_layer(spark, settings, "bronze").groupBy("load_day").count().collect()
    return {r.load_day: r["count"] for r in rows}


def test_state_starts_at_the_configured_day(spark, settings):
    ensure_namespace(spark, settings)
    assert read_progress(spark, settings) == Progress(settings.start)
    write_progress(spark, settings, Progress(date(2024, 12, 31)))
    row = read_layer(spark, settings, "progress").first()
    assert (row.year, row.month, row.day) == ("2024", "12", 31)
    assert read_progress(spark, settings) == Progress(date(2024, 12, 31))


def test_daily_runs_over_a_month_end(spark, settings, root):
    s = _small(settings, retain_months=False)
    seen = []
    for _ in range(5):
        run_day(spark, s, root, at=AT)
        seen.append(_days(spark, s))
    d = date
    assert seen[0] == {d(2024, 7, 29): 5}
    assert seen[1] == {d(2024, 7, 29): 5}  # 30 July has no posts, the state moves on
    assert seen[2] == {d(2024, 7, 29): 5, d(2024, 7, 31): 5}
    assert seen[3] == {d(2024, 8, 1): 5}  # the first load of August clears July
    assert seen[4] == {d(2024, 8, 1): 5, d(2024, 8, 2): 5}
    assert read_progress(spark, s) == Progress(d(2024, 8, 3))
    scores = [r.score for r in read_layer(spark, s, "bronze").collect()]
    assert max(scores) == 6  # the best-scored posts are marked over_18
    ids = sorted(r.id for r in read_layer(spark, s, "bronze").collect())
    assert ids[:5] == sorted(f"2024-08-01-{n}" for n in (6, 13, 5, 12, 19))


def test_same_day_twice_leaves_the_same_table(spark, settings, root):
    s = _small(settings)
    run_day(spark, s, root, at=AT)
    run_range(spark, s, root, date(2024, 7, 31), at=AT)
    before = sorted(map(tuple, read_layer(spark, s, "bronze").collect()), key=str)
    write_progress(spark, s, Progress(date(2024, 7, 31)))
    run_day(spark, s, root, at=AT)
    assert sorted(map(tuple, read_layer(spark, s, "bronze").collect()), key=str) == before


def test_one_range_equals_daily_runs(spark, settings, root):
    daily = _small(settings)
    for _ in range(5):
        run_day(spark, daily, root, at=AT)
    expected = sorted(map(tuple, read_layer(spark, daily, "bronze").collect()), key=str)
    once = _small(settings, namespace=settings.namespace + "_r")
    run_range(spark, once, root, date(2024, 8, 2), at=AT)
    found = read_layer(spark, once, "bronze")
    order = read_layer(spark, daily, "bronze").columns
    assert sorted(map(tuple, found.select(*order).collect()), key=str) == expected
    assert read_progress(spark, once) == read_progress(spark, daily)
    assert run_range(spark, once, root, date(2024, 8, 1)) == Progress(date(2024, 8, 3))
    spark.sql(f"DROP DATABASE {once.namespace} CASCADE")


@pytest.mark.parametrize("retain", [False, True])
def test_catching_up_loads_every_day(spark, settings, root, retain):
    s = _small(settings, retain_months=retain)
    run_day(spark, s, root, at=AT)
    write_progress(spark, s, Progress(date(2024, 7, 29)))
    assert run_range(spark, s, root, date(2024, 9, 1), at=AT) == Progress(date(2024, 9, 2))
    assert _days(spark, s) == {date(2024, 7, 29): 5, date(2024, 7, 31): 5,
                               date(2024, 8, 1): 5, date(2024, 8, 2): 5}


def test_range_removes_days_that_lost_their_posts(spark, settings, root, tmp_path):
    s = _small(settings)
    run_range(spark, s, root, date(2024, 7, 31), at=AT)
    read_submissions(spark, root, date(2024, 7, 1)).where("id not like '2024-07-31%'").write.parquet(
        f"{tmp_path}/less/2024/07")
    write_progress(spark, s, Progress(date(2024, 7, 29)))
    run_range(spark, s, f"{tmp_path}/less", date(2024, 7, 31), at=AT)
    assert _days(spark, s) == {date(2024, 7, 29): 5}


def test_columns_that_appear_later_are_kept(spark, settings, root, tmp_path):
    read_submissions(spark, root, date(2024, 7, 1)).write.parquet(f"{tmp_path}/new/2024/07")
    read_submissions(spark, root, date(2024, 8, 1)).withColumn("awards", F.lit(3)).drop("url").write.parquet(
        f"{tmp_path}/new/2024/08")
    s = _small(settings)
    for _ in range(4):
        run_day(spark, s, f"{tmp_path}/new", at=AT)
    rows = read_layer(spark, s, "bronze").groupBy("load_day").agg(
        F.count("awards").alias("awards"), F.count("url").alias("urls")).collect()
    assert {r.load_day.month: (r.awards, r.urls) for r in rows} == {7: (0, 5), 8: (5, 0)}
    both = read_submissions(spark, f"{tmp_path}/new", date(2024, 7, 1), date(2024, 8, 1))
    assert "awards" in both.columns and "url" in both.columns


def test_absent_months_hold_no_posts(spark, root):
    assert read_submissions(spark, root, date(2024, 7, 1), date(2024, 12, 1)).count() == 84
    assert read_submissions(spark, root, date(2023, 1, 1)).count() == 0
    with pytest.raises(FileNotFoundError):
        read_submissions(spark, root + "-none", date(2024, 7, 1))


def test_rerun_of_a_day_that_lost_its_posts(spark, settings, root, tmp_path):
    s = _small(settings)
    run_day(spark, s, root, at=AT)
    spark.createDataFrame([], SUBMISSION_SCHEMA).write.parquet(f"{tmp_path}/empty/2024/07")
    write_progress(spark, s, Progress(date(2024, 7, 29)))
    run_day(spark, s, f"{tmp_path}/empty", at=AT)
    assert _days(spark, s) == {}


def test_reset_before_anything_was_loaded(spark, settings):
    ensure_namespace(spark, settings)
    reset_month(spark, settings)
    assert not layer_exists(spark, settings, "bronze")


def test_hive_layout_prunes_months(spark, root, tmp_path):
    for month in (7, 8):
        spark.read.parquet(f"{root}/2024/{month:02d}").write.parquet(
            f"{tmp_path}/hive/year=2024/month={month:02d}")
    df = read_submissions(spark, f"{tmp_path}/hive", date(2024, 8, 1), layout="hive")
    same = read_submissions(spark, root, date(2024, 8, 1))
    assert df.columns == same.columns
    assert df.count() == same.count() == 42
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(ValueError):
        read_submissions(spark, root, date(2024, 8, 1), layout="other")

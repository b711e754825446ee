"""Streaming queries in several micro-batches, restarted, and with late records."""

import pytest
from pyspark.sql import functions as F

from hearsay.operators.marts import daily_metrics
from hearsay.plans.layers import build_silver
from hearsay.scoring import enrich
from hearsay.session import path_exists, shared_scratch
from hearsay.sources.sample_posts import prose_scorers, sample_posts
from hearsay.streaming import posts as sp
from tests.compare import spark_rows


@pytest.fixture(scope="module")
def arrivals(spark, sf_dir, tmp_path_factory):
    """The sample posts as three files, in order of load date."""
    path = str(tmp_path_factory.mktemp("arrivals"))
    posts = sample_posts(spark, sf_dir)
    cuts = ["2024-01-12", "2024-01-22"]
    date = F.to_date("load_date")
    parts = [date < F.lit(cuts[0]), date.between(*cuts), date > F.lit(cuts[1])]
    for n, part in enumerate(parts):
        posts.where(part).coalesce(1).write.parquet(f"{path}/arrival={n}")
    return path, posts.schema


def _stream(spark, arrivals):
    path, schema = arrivals
    return sp.read_posts(spark, f"{path}/arrival=*", schema, files_per_batch=1)


def _run(*started):
    sp.finish(started)
    return started[0].recentProgress


def test_silver_over_three_batches_equals_batch_silver(spark, sf_dir, arrivals):
    base = shared_scratch(spark, "silver")
    progress = _run(sp.start_silver(_stream(spark, arrivals), f"{base}/out", f"{base}/state"))
    assert len([p for p in progress if p["numInputRows"]]) == 3
    expected = spark_rows(build_silver(sample_posts(spark, sf_dir)))
    assert spark_rows(spark.read.parquet(f"{base}/out").drop("post_date")) == expected
    _run(sp.start_silver(_stream(spark, arrivals), f"{base}/out", f"{base}/state"))
    assert spark_rows(spark.read.parquet(f"{base}/out").drop("post_date")) == expected


def test_replayed_batch_restores_a_torn_copy(spark, sf_dir, arrivals):
    """The target lost a partition while it was copied; the staged batch brings it back."""
    base = shared_scratch(spark, "torn")
    posts = sample_posts(spark, sf_dir)
    early = posts.where("to_date(load_date) < '2024-01-12'")
    late = posts.where("to_date(load_date) >= '2024-01-12'")
    sp.merge_latest(early, 0, f"{base}/out", f"{base}/staging")
    sp.merge_latest(late, 1, f"{base}/out", f"{base}/staging")
    assert not path_exists(spark, f"{base}/staging/batch-0")
    expected = spark_rows(spark.read.parquet(f"{base}/out"))
    lost = spark.read.parquet(f"{base}/staging/batch-1").select("post_date").first()[0]
    spark.read.parquet(f"{base}/out").where(F.col("post_date") != lost).write.partitionBy(
        "post_date").parquet(f"{base}/out2")
    sp.merge_latest(late, 1, f"{base}/out2", f"{base}/staging")
    assert spark_rows(spark.read.parquet(f"{base}/out2")) == expected


def test_empty_batches_change_nothing(spark, sf_dir):
    base = shared_scratch(spark, "empty")
    posts = sample_posts(spark, sf_dir)
    none = posts.limit(0)
    for n, batch in enumerate([none, posts, none, none]):
        sp.merge_latest(batch, n, f"{base}/out", f"{base}/staging")
        sp.append_first(batch, f"{base}/first")
    expected = spark_rows(build_silver(posts))
    assert spark_rows(spark.read.parquet(f"{base}/out").drop("post_date")) == expected
    assert spark.read.parquet(f"{base}/first").count() == 1000


def test_posts_without_a_date_are_merged(spark, sf_dir):
    base = shared_scratch(spark, "undated")
    posts = sample_posts(spark, sf_dir).withColumn("created_utc", F.lit(None).cast("bigint"))
    for n in range(2):
        sp.merge_latest(posts, n, f"{base}/out", f"{base}/staging")
        sp.append_first(posts, f"{base}/first")
    assert spark.read.parquet(f"{base}/out").count() == 1000
    assert spark.read.parquet(f"{base}/first").count() == 1000


def test_newest_first_files_lose_nothing(spark, tmp_path, sf_dir):
    """One file per batch, the newest posts first."""
    posts = sample_posts(spark, sf_dir).where("CAST(id AS BIGINT) < 302")
    for n in range(3):
        posts.where(F.day("created_at").between(31 - 10 * (n + 1), 31 - 10 * n)).coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")
    stream = sp.read_posts(spark, f"{tmp_path}/in", posts.schema, files_per_batch=1)
    _run(sp.start_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state"))
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert kept.count() == kept.select("id").distinct().count() == 302


def test_restarted_ingest_adds_nothing(spark, sf_dir, arrivals):
    base = shared_scratch(spark, "restart")
    for state in ("a", "a", "b"):  # the last run replays every batch
        _run(sp.start_ingest(_stream(spark, arrivals), f"{base}/out", f"{base}/state-{state}"))
    kept = spark.read.parquet(f"{base}/out").drop("post_date")
    first = sample_posts(spark, sf_dir).where("to_date(load_date) = to_date(created_at) + 1")
    assert spark_rows(kept) == spark_rows(first)


def test_daily_equals_the_batch_mart(spark, sf_dir, arrivals):
    base = shared_scratch(spark, "daily")
    stream = _stream(spark, arrivals)
    _run(sp.start_ingest(stream, f"{base}/posts", f"{base}/ingest"))
    stored = spark.read.parquet(f"{base}/posts")
    posts = sp.read_posts(spark, f"{base}/posts", stored.schema, files_per_batch=5)
    _run(sp.start_daily(posts, f"{base}/posts", f"{base}/out", f"{base}/state",
                        lambda p: enrich(p, prose_scorers())))
    batch = daily_metrics(enrich(stored, prose_scorers()))
    found = spark.read.parquet(f"{base}/out").select(*batch.columns)
    assert spark_rows(found) == spark_rows(batch)


def test_scratch_follows_the_cluster_setting(spark):
    assert shared_scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_scratch(spark, "x") != shared_scratch(spark, "x")

"""What jobs leave on the disks of the executors."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearsay.checks.queries import queries
from hearsay.config import Settings
from hearsay.functions.filters import post_date
from hearsay.operators import rounds
from hearsay.operators.explore import rows_of_first
from hearsay.plans.layers import build_gold, build_silver, silver_parts
from hearsay.plans.refresh import refresh_gold, refresh_silver
from hearsay.session import SHUFFLES_FREED, path_exists, shared_scratch
from hearsay.sinks.tables import drop_layer, ensure_namespace, replace_dates, write_layer
from hearsay.sources.sample_posts import prose_scorers, sample_posts
from hearsay.sources.tables import read_layer
from hearsay.streaming import posts as sp
from tests.compare import spark_rows

START = datetime(2024, 1, 1)


def shuffled(spark):
    """Bytes of the shuffle files that are there."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(f"{d}/{f}") for at in dirs for d, _, names in os.walk(str(at))
               for f in names if f.startswith("shuffle_"))


def posts_tables(spark, path, posts, step=10, size=20_000):
    """Tables of ``posts`` events with long texts, of which every tenth number is a post with a second copy."""
    events = spark.range(posts).select(
        (F.col("id") * step).alias("event_id"), (F.lit(START) + F.expr("INTERVAL 1 HOUR") * (F.col("id") % 600)).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 90).alias("user_id"), F.element_at(F.array(*map(F.lit, ("view", "error", "signup"))), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 700 / 3).alias("value"), F.lit('{"k": 3}').alias("props"))
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size // 32)), lambda i: F.md5(F.concat(F.col("id"), F.lit("-"), i))), " ")
    spark.range(7).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
                          F.lit(size).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """Posts that all come twice."""
    return posts_tables(spark, str(tmp_path_factory.mktemp("twice")), 1500)


def test_a_few_labelled_posts_shuffle_few_texts(spark, twice):
    before = shuffled(spark)
    found = queries()["sample_labelled_posts"](spark, twice).collect()
    assert [r.id for r in found] == sorted(str(10 * i) for i in range(1500))[:10]
    assert shuffled(spark) - before < 4_000_000  # of 60 MB of texts


def test_rows_of_the_first_keys(spark):
    rows = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("c", 4), ("b", 5), (None, 6)], "id string, n int")
    assert sorted(r.n for r in rows_of_first(rows, 2).collect()) == [2, 3, 6]
    assert sorted(r.n for r in rows_of_first(rows.where("id IS NOT NULL"), 2).collect()) == [1, 3, 5]
    assert rows_of_first(rows.limit(0), 2).count() == 0


def written(spark, path):
    return sorted(map(str, spark.read.parquet(path).drop("post_date").collect()))


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Posts of which every tenth comes twice."""
    return posts_tables(spark, str(tmp_path_factory.mktemp("mixed")), 400, step=1, size=4_000)


@pytest.mark.parametrize("size", [200_000, None])
def test_streams_keep_their_rows_in_rounds_and_leave_no_shuffles(spark, mixed, monkeypatch, size):
    posts = sample_posts(spark, mixed)
    odd = posts.where("id IN ('3', '5', '7')").withColumn("id", F.lit(None).cast("string"))
    posts = posts.unionByName(odd).unionByName(posts.where("id = '8'")).repartition(3).localCheckpoint()
    want = sorted(map(str, build_silver(posts).collect()))
    first = sorted(map(str, sp.first_in_batch(posts).collect()))
    if size:
        monkeypatch.setattr(rounds, "ROUND_BYTES", size)
        monkeypatch.setattr(rounds, "MOST_ROUNDS", 3)
        assert rounds.rounds_for(posts) == 3
    base, before = shared_scratch(spark, "rounds"), shuffled(spark)
    sp.merge_latest(posts, 0, f"{base}/silver", f"{base}/staging")
    for rows in (posts, posts.where("id IS NOT NULL")):  # the second time as a replay
        sp.append_first(rows, f"{base}/first")
    assert shuffled(spark) - before < 300_000  # of 2 MB of texts
    assert spark.conf.get(SHUFFLES_FREED, "false") == "false"
    assert written(spark, f"{base}/silver") == want and len(want) == 401
    assert written(spark, f"{base}/first") == first and len(first) == 401
    assert not path_exists(spark, f"{base}/staging")  # nothing was there to lose
    sp.merge_latest(posts, 1, f"{base}/silver", f"{base}/staging")
    assert written(spark, f"{base}/silver") == want


def test_a_batch_that_died_between_rounds_is_completed(spark, mixed, monkeypatch):
    posts = sample_posts(spark, mixed).localCheckpoint()
    want, base = sorted(map(str, build_silver(posts).collect())), shared_scratch(spark, "died")
    monkeypatch.setattr(rounds, "ROUND_BYTES", 600_000)
    parts = [p for p, _ in zip(silver_parts(posts, 1_600_000), range(2))]
    for part in parts:
        part.withColumn("post_date", post_date()).write.mode("append").partitionBy("post_date").parquet(f"{base}/out")
    assert 0 < spark.read.parquet(f"{base}/out").count() < 400
    sp.merge_latest(posts, 0, f"{base}/out", f"{base}/staging")
    assert written(spark, f"{base}/out") == want


@pytest.mark.parametrize("generations", [False, True])
def test_layers_in_rounds_hold_every_post_once(spark, mixed, settings, monkeypatch, generations):
    s = Settings(namespace=settings.namespace, generations=generations)
    ensure_namespace(spark, s)
    posts = sample_posts(spark, mixed)
    scorers = prose_scorers()
    want = spark_rows(build_gold(build_silver(posts), scorers))
    monkeypatch.setattr(rounds, "ROUND_BYTES", 900_000)
    before = shuffled(spark)
    edited = posts.withColumn("selftext", F.when(F.col("id").cast("long") % 7 == 0, "with by").otherwise(F.col("selftext")))
    for rows in (edited, posts):
        write_layer(rows, s, "bronze")
        refresh_silver(spark, s)
        check = refresh_gold(spark, s, scorers, cluster_by=("subreddit",), only_changed=True).first()
        assert check.ok and check.expected == 400
    assert shuffled(spark) - before < 300_000
    assert spark_rows(read_layer(spark, s, "gold").drop("post_date")) == want
    for layer in ("bronze", "silver"):
        drop_layer(spark, s, layer)
    assert not any("bronze" in t.name or "silver" in t.name for t in spark.catalog.listTables(s.namespace))
    assert spark_rows(read_layer(spark, s, "gold").drop("post_date")) == want


def test_dates_in_rounds_are_gathered_without_a_sort(spark, mixed, settings):
    ensure_namespace(spark, settings)
    posts = sample_posts(spark, mixed).withColumn("post_date", post_date())
    replace_dates(posts, settings, "bronze", None, rounds=3)
    assert spark_rows(read_layer(spark, settings, "bronze").select(*posts.columns)) == spark_rows(posts)
    replace_dates(read_layer(spark, settings, "bronze"), settings, "silver", None, gathered=True)
    assert spark_rows(read_layer(spark, settings, "silver").select(*posts.columns)) == spark_rows(posts)

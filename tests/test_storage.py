"""Layout of stored layers: what readers skip, and joins without a shuffle."""

import glob
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hearsay.config import Settings
from hearsay.plans.refresh import refresh_gold, refresh_silver
from hearsay.scoring.enrich import rescore_changed
from hearsay.sinks.tables import ensure_namespace, laid_out, write_layer
from hearsay.session import shared_scratch
from hearsay.sources.footers import CONF, count_stored, footer_reading, stored_aggregate, stored_date_range
from hearsay.sources.sample_posts import prose_scorers, sample_posts
from hearsay.sources.tables import read_layer
from tests.compare import spark_rows


def overlapping(path, column, value):
    """Files whose statistics do not exclude ``value``, and all files."""
    met = files = 0
    for name in glob.glob(f"{path.replace('file:', '')}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = [meta.schema.column(i).name for i in range(len(meta.schema))].index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        files += 1
        met += any(s.min <= value <= s.max for s in stats)
    return met, files


def test_a_filter_on_either_clustered_column_skips_files(spark):
    """A hot subreddit with a third of all posts, and sentiments that have nothing to do with it."""
    n = F.col("id").cast("long")
    posts = spark.range(30_000).select(F.col("id").cast("string").alias("id")).withColumns({
        "subreddit": F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.xxhash64("id") % 200).cast("string"))),
        "sentiment": F.element_at(F.array(*map(F.lit, ("negative", "neutral", "positive"))), (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(3)) + 1).cast("int"))})
    met = {}
    for interleave in (False, True):
        path = shared_scratch(spark, "clustered")
        laid_out(posts, cluster_by=("subreddit", "sentiment"), partitions=24, interleave=interleave).write.parquet(path)
        met[interleave] = [overlapping(path, c, v) for c, v in (("subreddit", "s77"), ("sentiment", "negative"), ("subreddit", "hot"))]
        assert spark.read.parquet(path).count() == 30_000
    assert all(files >= 20 for _, files in met[True])
    assert met[True][1][0] <= 0.75 * met[True][1][1] < met[False][1][0]
    assert met[True][0][0] <= 0.5 * met[True][0][1]
    assert met[True][2][0] >= 5  # a hot value is spread over many files


@pytest.mark.parametrize("column", ["subreddit", "sentiment"])
def test_interleaving_takes_nulls_and_single_values(spark, column):
    posts = spark.range(50).selectExpr("cast(id as string) AS id", "cast(null as string) AS subreddit", "'x' AS sentiment")
    assert laid_out(posts, cluster_by=("subreddit", "sentiment"), interleave=True).where(f"{column} IS NULL").count() in (0, 50)
    assert laid_out(posts.limit(0), cluster_by=("subreddit", "sentiment"), interleave=True).count() == 0


def test_buckets_join_without_a_shuffle(spark, sf_dir, settings):
    s = Settings(namespace=settings.namespace, buckets=4, generations=True)
    ensure_namespace(spark, s)
    posts = sample_posts(spark, sf_dir)
    write_layer(posts.withColumn("selftext", F.when(F.col("id") % 3 != 0, F.col("selftext"))), s, "bronze")
    refresh_silver(spark, s)
    refresh_gold(spark, s, prose_scorers())
    write_layer(posts, s, "bronze")
    refresh_silver(spark, s)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = rescore_changed(read_layer(spark, s, "silver"), read_layer(spark, s, "gold"), prose_scorers())
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        refresh_gold(spark, s, prose_scorers(), only_changed=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    from hearsay.plans.layers import build_gold, build_silver
    columns = ["id", "sentiment", "sentiment_confidence", "topic", "emotion", "score"]
    want = build_gold(build_silver(posts), prose_scorers()).select(columns)
    assert spark_rows(read_layer(spark, s, "gold").select(columns)) == spark_rows(want)


def test_counts_and_dates_come_from_footers(spark, sf_dir, settings):
    ensure_namespace(spark, settings)
    posts = sample_posts(spark, sf_dir).where("created_at < DATE '2024-01-20'")
    write_layer(posts, settings, "silver", by_post_date=True)
    before = {k: spark.conf.get(k) for k in CONF}
    with footer_reading(spark):
        plan = stored_aggregate(spark, settings, "silver", F.count("*"), F.min("created_utc"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(created_utc)]" in plan
    assert count_stored(spark, settings, "silver") == posts.count()
    assert stored_date_range(spark, settings, "silver") == (date(2024, 1, 1), date(2024, 1, 19))
    assert {k: spark.conf.get(k) for k in CONF} == before
    write_layer(posts.limit(0), settings, "gold")
    assert count_stored(spark, settings, "gold") == 0 and stored_date_range(spark, settings, "gold") is None

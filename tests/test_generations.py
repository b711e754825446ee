"""Generations behind views, months of different types, and days that close."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hearsay.config import Settings
from hearsay.plans.refresh import read_mart, refresh_gold, refresh_marts, refresh_silver
from hearsay.session import path_exists, shared_scratch
from hearsay.sinks.tables import current_generation, ensure_namespace, write_layer
from hearsay.sources.sample_posts import prose_scorers, sample_posts
from hearsay.sources.submissions import read_submissions
from hearsay.sources.tables import read_layer
from hearsay.streaming import days
from hearsay.streaming.posts import finish, read_posts
from tests.compare import spark_rows


@pytest.fixture
def kept(spark, settings):
    chosen = Settings(namespace=settings.namespace, generations=True)
    ensure_namespace(spark, chosen)
    return chosen


def tables(spark, s):
    return {t.name for t in spark.catalog.listTables(s.namespace)}


def test_a_reader_sees_one_generation(spark, kept):
    write_layer(spark.range(10), kept, "silver")
    before = read_layer(spark, kept, "silver")
    write_layer(spark.range(5, 8).withColumn("more", F.lit(1)), kept, "silver")
    assert before.count() == 10  # the frame of a reader that began before
    assert sorted(r["id"] for r in read_layer(spark, kept, "silver").collect()) == [5, 6, 7]
    write_layer(spark.range(1), kept, "silver")
    assert read_layer(spark, kept, "silver").columns == ["id"]
    assert len(tables(spark, kept)) == 3  # the view, its generation and the one before


def test_a_failed_rewrite_changes_nothing(spark, kept):
    write_layer(spark.range(10), kept, "silver")
    at = current_generation(spark, kept, "silver")
    broken = spark.range(10).select((F.lit(1) / (F.col("id") - 7)).alias("id"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        write_layer(broken, kept, "silver")
    assert current_generation(spark, kept, "silver") == at
    assert read_layer(spark, kept, "silver").count() == 10
    write_layer(spark.range(3), kept, "silver")  # what the failed run left goes with the next switch
    assert len(tables(spark, kept)) == 3


def test_a_rewrite_may_read_what_it_replaces(spark, kept):
    write_layer(spark.range(4), kept, "silver")
    write_layer(read_layer(spark, kept, "silver").withColumn("id", F.col("id") * 2), kept, "silver")
    assert sorted(r["id"] for r in read_layer(spark, kept, "silver").collect()) == [0, 2, 4, 6]


def test_plain_tables_are_not_overwritten(spark, kept):
    spark.range(2).write.saveAsTable(kept.table("silver"))
    with pytest.raises(ValueError, match="plain table"):
        write_layer(spark.range(3), kept, "silver")
    assert read_layer(spark, kept, "silver").count() == 2


def test_layers_and_marts_in_generations(spark, sf_dir, kept):
    write_layer(sample_posts(spark, sf_dir), kept, "bronze")
    for _ in range(2):
        refresh_silver(spark, kept)
        assert refresh_gold(spark, kept, prose_scorers(), only_changed=True).first()["ok"]
        refresh_marts(spark, kept)
    gold = read_layer(spark, kept, "gold")
    assert read_mart(spark, kept, "daily_metrics").agg(F.sum("total_posts")).first()[0] == gold.count()
    day = gold.where(F.col("post_date") == F.lit(date(2024, 1, 5)))
    assert "PartitionFilters: [isnotnull(post_date" in day._jdf.queryExecution().executedPlan().toString()


def test_months_of_different_types_keep_every_value(spark):
    root = shared_scratch(spark, "months")
    big = 2 ** 60 + 1
    spark.createDataFrame([("a", 1, 1.5, date(2024, 1, 1), "x")], "id string, score int, n float, d date, old string").write.parquet(f"{root}/2024/01")
    spark.createDataFrame([("b", big, 2.25, datetime(2024, 2, 1, 5), 7)], "id string, score long, n double, d timestamp_ntz, new int").write.parquet(f"{root}/2024/02")
    spark.createDataFrame([("c", "many", big)], "id string, score string, n long").write.parquet(f"{root}/2024/03")
    two = read_submissions(spark, root, date(2024, 1, 1), date(2024, 2, 1))
    assert dict(two.dtypes) == {"id": "string", "score": "bigint", "n": "double", "d": "timestamp_ntz", "old": "string", "new": "int"}
    rows = {r["id"]: r.asDict() for r in two.collect()}
    assert rows["a"]["score"] == 1 and rows["b"]["score"] == big and rows["a"]["d"] == datetime(2024, 1, 1) and rows["a"]["new"] is None
    three = read_submissions(spark, root, date(2024, 1, 1), date(2024, 3, 1))
    found = {r["id"]: (r["score"], r["n"]) for r in three.collect()}
    assert found == {"a": ("1", "1.5"), "b": (str(big), "2.25"), "c": ("many", str(big))}
    plan = two.select("id").where("score > 3")._jdf.queryExecution().executedPlan().toString()
    assert "old" not in plan.split("ReadSchema")[1].split("\n")[0]


def _label(df):
    for k in ("sentiment", "emotion", "topic"):
        df = df.withColumns({k: F.lit("positive" if k == "sentiment" else "x"), f"{k}_confidence": F.lit(0.5)})
    return df


def test_days_close_once_and_late_posts_are_merged(spark, sf_dir):
    """Three arrivals; the second holds posts of days that the first has closed."""
    base = shared_scratch(spark, "closing")
    posts = sample_posts(spark, sf_dir).where("id % 10 <> 0 OR load_date < created_at + INTERVAL 36 HOURS")
    day = F.to_date("created_at")
    # of two days a quarter is late, of a third one all
    late = (day < F.lit("2024-01-03")) & (F.col("id").cast("long") % 4 == 1) | (day == F.lit("2024-01-04"))
    parts = [(day < F.lit("2024-01-09")) & ~late, (day >= F.lit("2024-01-09")) & (day < F.lit("2024-01-15")) | late, day >= F.lit("2024-01-15")]
    stored = posts.withColumn("post_date", day)
    schema = stored.schema
    for part in parts:
        stored.where(part).coalesce(1).write.mode("append").partitionBy("post_date").parquet(f"{base}/posts")
        stream = read_posts(spark, f"{base}/posts", spark.read.schema(schema).parquet(f"{base}/posts").schema)
        finish([days.start_closing(stream, f"{base}/parts", f"{base}/state", _label, "1 day")])
    every = spark.read.schema(schema).parquet(f"{base}/posts")
    closed = spark.read.parquet(f"{base}/parts")
    missing = days.late_days(closed, every).collect()
    lost = posts.where(late).count()
    assert sum(r["stored"] - r["counted"] for r in missing) == lost > 0
    assert days.merge_late(spark, f"{base}/parts", every, f"{base}/late", _label) == len(missing) == 3
    assert days.merge_late(spark, f"{base}/parts", every, f"{base}/late", _label) == 0
    assert spark.read.parquet(f"{base}/late").count() == 3
    got = days.metrics_of_days(spark.read.parquet(f"{base}/parts"))
    last = got.agg(F.max("post_date")).first()[0]
    newest = posts.agg(F.max(day)).first()[0]
    assert (newest - last).days == 2  # one day of delay and the open day
    from hearsay.operators.marts import daily_metrics
    want = daily_metrics(_label(posts)).where(F.col("post_date") <= F.lit(last))
    assert spark_rows(got) == spark_rows(want)


def test_no_closed_day_is_no_work(spark):
    base = shared_scratch(spark, "nothing")
    assert not path_exists(spark, base)
    assert days.merge_late(spark, f"{base}/parts", spark.range(0), f"{base}/late", _label) == 0

"""Silver, gold and marts as tables, CSV pages and run metrics."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from hearsay.checks.queries import queries
from hearsay.operators import marts as m
from hearsay.plans.layers import build_gold, build_silver, label_then_dedup
from hearsay.plans.refresh import read_mart, refresh_gold, refresh_marts, refresh_silver
from hearsay.scoring.model import ModelScorer
from hearsay.sinks.tables import ensure_namespace, export_csv, laid_out, write_days, write_layer
from hearsay.sources.sample_posts import prose_scorers, sample_posts
from hearsay.sources.tables import STAGED_COLUMNS, layer_exists, read_layer, stage_gold
from tests.compare import spark_rows


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    """A namespace with every layer and mart built from the sample posts."""
    from hearsay.config import Settings

    s = Settings(namespace="ns_layers")
    ensure_namespace(spark, s)
    posts = sample_posts(spark, sf_dir).withColumn("load_day", F.to_date("created_at"))
    write_days(posts, s)
    checks = [refresh_silver(spark, s).first(),
              refresh_gold(spark, s, prose_scorers(), cluster_by=("subreddit", "sentiment"),
                           run_id="r1").first()]
    sizes = refresh_marts(spark, s)
    yield s, checks, sizes
    spark.sql("DROP DATABASE ns_layers CASCADE")


def test_writes_are_verified(stored):
    _, checks, _ = stored
    assert [(c.layer, c.expected, c.actual, c.ok) for c in checks] == [
        ("silver", 1000, 1000, True), ("gold", 1000, 1000, True)]


def test_stored_gold_equals_the_lazy_one(spark, sf_dir, stored):
    s, _, _ = stored
    gold = read_layer(spark, s, "gold")
    assert set(gold.columns) == {*STAGED_COLUMNS, "load_day", "post_date"}
    lazy = build_gold(build_silver(sample_posts(spark, sf_dir)), prose_scorers())
    assert spark_rows(stage_gold(gold)) == spark_rows(stage_gold(lazy, "staged_posts"))
    assert spark.table("staged_posts").count() == 1000


def test_label_then_dedup_equals_gold(spark, sf_dir, stored):
    s, _, _ = stored
    columns = [c for c in STAGED_COLUMNS if c not in ("title", "selftext", "url")]
    narrow = label_then_dedup(sample_posts(spark, sf_dir), columns, prose_scorers())
    assert spark_rows(narrow) == spark_rows(read_layer(spark, s, "gold").select(*columns))


@pytest.mark.parametrize("name", sorted(m.BUILDERS))
def test_stored_marts(spark, sf_dir, stored, name):
    s, _, sizes = stored
    mart = read_mart(spark, s, name)
    assert mart.count() == sizes[name]
    stored_mart = mart
    if name == "topic_trends":
        stored_mart = mart.withColumn("related_subreddits",
                                      F.array_join("related_subreddits", ","))
    assert spark_rows(stored_mart) == spark_rows(queries()[name](spark, sf_dir))
    first = [r[m.MART_ORDER[name][0]] for r in mart.collect()]
    assert first == sorted(first, reverse=True)


def test_refreshing_again_changes_nothing(spark, stored):
    s, _, sizes = stored
    assert refresh_marts(spark, s) == sizes


def test_gold_is_partitioned_and_clustered(spark, stored):
    s, _, _ = stored
    day = read_layer(spark, s, "gold").where(F.col("post_date") == date(2024, 1, 10))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "post_date" in plan.split("PartitionFilters")[1].split("]")[0]
    assert day.count() > 0


def test_run_metrics(spark, stored):
    s, _, _ = stored
    run = read_layer(spark, s, "run_metrics").where("run_id = 'r1'")
    values = {(r.kind, r.key): r.value for r in run.collect()}
    assert values["metric", "total_records_processed"] == "1000"
    assert values["metric", "sentiment_errors_count"] == "0"
    assert values["param", "target_table"] == "ns_layers.posts_gold"
    assert values["param", "topic_categories"].startswith("Technology & Science, News")
    topics = [int(v) for (kind, key), v in values.items()
              if key.startswith("topic_") and key.endswith("_count") and kind == "metric"
              and "errors" not in key]
    assert sum(topics) == 1000


def test_scoring_errors_are_counted(spark, settings):
    ensure_namespace(spark, settings)
    rows = [(str(i), "bad" if i % 3 == 0 else "fine") for i in range(9)]
    silver = spark.createDataFrame(rows, "id string, title string").withColumn(
        "selftext", F.lit(None).cast("string"))
    write_layer(silver, settings, "silver")

    def load():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [("joy", 1.0)] * len(texts)
        return predict

    refresh_gold(spark, settings, [ModelScorer("emotion", ("joy",), "neutral", load)],
                 by_post_date=False, run_id="r")
    metrics = {r.key: r.value for r in read_layer(spark, settings, "run_metrics").collect()}
    assert metrics["emotion_errors_count"] == "3"
    assert metrics["emotion_joy_count"] == "6"
    assert "emotion_error" not in read_layer(spark, settings, "gold").columns


def test_layout_splits_a_hot_cluster(spark):
    df = spark.range(9000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("subreddit"))
    out = laid_out(df, cluster_by=("subreddit",), partitions=6)
    sizes = [r["count"] for r in
             out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 9000 / 3


def test_layer_schema_is_replaced(spark, settings):
    ensure_namespace(spark, settings)
    assert not layer_exists(spark, settings, "silver")
    write_layer(spark.range(3), settings, "silver")
    write_layer(spark.range(2).withColumn("x", F.lit("y")), settings, "silver")
    assert read_layer(spark, settings, "silver").columns == ["id", "x"]
    assert read_layer(spark, settings, "silver").count() == 2


def test_namespace_keeps_its_comment(spark, settings):
    ensure_namespace(spark, settings)
    ensure_namespace(spark, settings)
    rows = {r[0]: r[1] for r in spark.sql(f"DESCRIBE DATABASE {settings.namespace}").collect()}
    assert rows["Comment"] == settings.comment


def test_csv_export(spark, tmp_path, sf_dir):
    page = queries()["explore_recent"](spark, sf_dir)
    export_csv(page, f"{tmp_path}/page")
    back = spark.read.option("header", True).csv(f"{tmp_path}/page")
    assert back.columns == page.columns
    assert back.count() == 100


def test_gold_scores_only_new_and_edited_posts(spark, settings, tmp_path):
    """The stand-in model notes every text it is given."""
    log = str(tmp_path)

    def load():
        import uuid

        def predict(texts):
            for t in texts:
                with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                    f.write(t)
            return [("x", 0.5)] * len(texts)
        return predict

    scorer = ModelScorer("sentiment", ("x",), "none", load)
    ensure_namespace(spark, settings)

    def refresh(rows):
        silver = spark.createDataFrame(rows, "id string, title string, selftext string, created_utc bigint")
        write_layer(silver, settings, "silver")
        refresh_gold(spark, settings, [scorer], run_id="r", only_changed=True)
        seen = sorted(p.read_text() for p in tmp_path.iterdir())
        for p in tmp_path.iterdir():
            p.unlink()
        return seen, read_layer(spark, settings, "gold").count()

    assert refresh([("1", "a", "b", 0), ("2", "c", "d", 0)]) == (["a b", "c d"], 2)
    assert refresh([("1", "a", "b", 0), ("2", "c", "new", 0), ("3", "e", "f", 0)]) == (["c new", "e f"], 3)
    assert refresh([("1", "a", "b", 0), ("2", "c", "new", 0), ("3", "e", "f", 0)]) == ([], 3)
    runs = read_layer(spark, settings, "run_metrics").where("key = 'total_records_processed'").collect()
    assert [r["value"] for r in runs] == ["3"]

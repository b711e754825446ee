"""Look-ups by id: row groups are skipped, and nothing stored is added again."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from hearsay.session import shared_scratch
from hearsay.sources.lookup import (
    LOOKUP_IDS, PUSHED_VALUES, few_at_a_time, id_filters, values_pushed, with_ids,
)
from hearsay.sources.sample_posts import sample_posts
from hearsay.streaming import posts as sp
from tests.compare import spark_rows

FILES, ROWS = 40, 40_000


def rows_read(df):
    """The result, and the rows of the row groups that the scan opened."""
    found = df.collect()
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    return found, sum(scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()))


@pytest.fixture(scope="module")
def stored(spark):
    """Posts in many files, each of which covers the whole range of ids, with and without filters."""
    rows = spark.range(ROWS).select(F.sha1(F.col("id").cast("string")).alias("id"), F.col("id").alias("n"))
    paths = {}
    for name, options in (("plain", {}), ("filtered", id_filters())):
        paths[name] = shared_scratch(spark, f"lookup-{name}")
        rows.repartition(FILES, "n").write.options(**options).parquet(paths[name])
    return paths


def some_ids(spark, n):
    return [r[0] for r in spark.range(0, ROWS, ROWS // n).limit(n).select(F.sha1(F.col("id").cast("string"))).collect()]


@pytest.mark.parametrize("n, groups", [(1, 1), (5, 5), (20, 20)])
def test_row_groups_without_the_ids_are_skipped(spark, stored, n, groups):
    ids = some_ids(spark, n)
    with values_pushed(spark):
        found, read = rows_read(with_ids(spark.read.parquet(stored["filtered"]), ids))
        same, whole = rows_read(with_ids(spark.read.parquet(stored["plain"]), ids))
    assert sorted(found) == sorted(same) and sorted(r["id"] for r in found) == sorted(ids)
    assert whole >= 0.95 * ROWS  # ranges of ids alone skip next to nothing
    assert read <= (groups + 1) * 1.3 * ROWS / FILES


def test_a_full_look_up_of_absent_ids_opens_next_to_nothing(spark, stored):
    absent = [f"{i:040x}" for i in range(LOOKUP_IDS)]
    spread = [r[0] for r in spark.createDataFrame([(i,) for i in absent], "id string").select(F.sha1("id")).collect()]
    df = spark.read.parquet(stored["filtered"])
    with values_pushed(spark):
        found, read = rows_read(with_ids(df, spread))
    assert found == [] and read <= 0.15 * ROWS


def test_settings_are_restored_and_rows_do_not_depend_on_them(spark, stored):
    ids, before = some_ids(spark, 50), spark.conf.get(PUSHED_VALUES)
    with pytest.raises(KeyError):
        with values_pushed(spark):
            raise KeyError
    assert spark.conf.get(PUSHED_VALUES) == before
    assert with_ids(spark.read.parquet(stored["filtered"]), [*ids, None, None]).count() == 50
    assert with_ids(spark.read.parquet(stored["filtered"]), [None]).count() == 0


def test_small_dates_are_chosen_first():
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    assert few_at_a_time({days[0]: 5, days[1]: 3, days[2]: 2}, 5) == [days[2], days[1]]
    assert few_at_a_time({days[0]: 2, None: 2, days[1]: 2}, 4) == days[:2]
    assert few_at_a_time({days[0]: 6}, 5) == [] == few_at_a_time({}, 5)


@pytest.mark.parametrize("limit", [0, 20, LOOKUP_IDS, 10**6])
def test_ingest_keeps_the_same_posts_whatever_is_looked_up(spark, sf_dir, monkeypatch, limit):
    """Three batches, of which the last two repeat stored posts of some dates and bring late ones."""
    monkeypatch.setattr(sp, "few_at_a_time", lambda counts: few_at_a_time(counts, limit))
    base, posts = shared_scratch(spark, "late"), sample_posts(spark, sf_dir)
    n = F.col("id").try_cast("long")
    undated = posts.where(n < 40).withColumn("created_utc", F.lit(None).cast("bigint")).withColumn("id", F.concat(F.lit("u"), "id"))
    known = posts.unionByName(undated)
    for batch in (known.where(n.isNull() | (n % 3 != 0)), known.where(n.isNull() | (n % 7 == 0)), known):
        sp.append_first(batch, base)
    kept = spark.read.parquet(base)
    assert kept.count() == kept.select("id").distinct().count() == 1040
    assert spark_rows(kept.select("id")) == spark_rows(known.select("id").distinct())
    assert kept.where("post_date IS NULL").count() == 40


def test_late_posts_of_an_old_date_open_few_row_groups(spark):
    """An ingest folder with one large date, then a batch of ten of its posts and ten new ones."""
    base = shared_scratch(spark, "large-date")
    row = spark.range(ROWS).select(
        F.sha1(F.col("id").cast("string")).alias("id"), F.col("id").alias("score"),
        F.lit(1_704_067_200).cast("long").alias("created_utc"), F.lit("2024-01-02").cast("timestamp").alias("load_date"),
        F.to_date(F.lit("2024-01-01")).alias("post_date"))
    row.repartition(FILES, "score").write.options(**id_filters()).partitionBy("post_date").parquet(base)
    old, day = row.where("score < 10"), date(2024, 1, 1)
    new = old.withColumn("id", F.concat(F.lit("new"), "score"))
    fresh = old.unionByName(new)
    with values_pushed(spark):
        found, read = rows_read(sp.held_ids(spark.read.schema(row.schema).parquet(base), fresh, {day: 20}))
    assert {r["id"] for r in found} == {r["id"] for r in old.collect()}
    assert read <= 0.35 * ROWS
    sp.append_first(fresh.drop("post_date"), base)
    assert spark.read.parquet(base).count() == ROWS + 10

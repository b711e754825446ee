"""Top-k and deduplication: totals, ties, hot keys and random input."""

from collections import defaultdict
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from hearsay.operators.dedup import dedup_latest
from hearsay.operators.quality import dedup_report
from hearsay.operators.topk import top_per_group, top_rows

FEW = hyp(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
START = datetime(2024, 1, 1)
COPY = "id string, load_date timestamp_ntz, score bigint, title string"

copies = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 2), st.integers(0, 2),
              st.sampled_from(["x", "y"])),
    max_size=25,
)


def _copies(spark, rows):
    return spark.createDataFrame(
        [(i, START + timedelta(days=d), s, t) for i, d, s, t in rows], COPY).repartition(3)


@FEW
@given(copies)
def test_dedup_keeps_one_latest_row_per_id(spark, rows):
    df = _copies(spark, rows)
    kept = dedup_latest(df).collect()
    best = {}
    for i, d, s, _ in rows:
        best[i] = max(best.get(i, (d, s)), (d, s))
    found = {r.id: ((r.load_date - START).days, r.score) for r in kept}
    assert found == best and len(kept) == len(best)
    assert all((r.id, r.load_date, r.score, r.title) in {tuple(x) for x in df.collect()}
               for r in kept)
    assert sorted(map(str, dedup_latest(dedup_latest(df)).collect())) == sorted(map(str, kept))
    assert dedup_report(df).first().final_count == len(kept)


def test_ties_do_not_depend_on_partitioning(spark):
    rows = [("a", 1, 1, t) for t in "qwertyuiop"]
    kept = {dedup_latest(_copies(spark, rows).repartition(n)).first().title for n in (1, 2, 5, 9)}
    assert len(kept) == 1


scores = st.lists(st.tuples(st.sampled_from("xyz"), st.one_of(st.none(), st.integers(0, 5))),
                  max_size=40)


@FEW
@given(scores, st.integers(1, 4), st.integers(1, 3))
def test_top_per_group_equals_sorting(spark, rows, k, fan_in):
    rows = [(g, s, i) for i, (g, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "g string, s int, id int").repartition(4)
    order = [F.col("s").desc_nulls_last(), F.col("id").asc()]
    got = sorted(tuple(r) for r in top_per_group(df, ["g"], order, k, fan_in).select(
        "g", "id").collect())
    groups = defaultdict(list)
    for g, s, i in rows:
        groups[g].append((-s if s is not None else 1, i))
    assert got == sorted((g, i) for g, v in groups.items() for _, i in sorted(v)[:k])
    first = [r.id for r in top_rows(df, order, k).collect()]
    everything = sorted((-s if s is not None else 1, i) for _, s, i in rows)
    assert first == [i for _, i in everything[:k]]


def test_hot_day_keeps_its_top_posts(spark):
    """A third of all posts on one day, spread over many input tasks."""
    df = spark.range(0, 30000, numPartitions=40).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 300)
        .alias("day"), ((F.col("id") * 7919) % 30011).alias("score"))
    order = [F.col("score").desc(), F.col("id").asc()]
    top = top_per_group(df, ["day"], order, 10, fan_in=4)
    hot = [r.id for r in top.where("day = 0").orderBy(*order).collect()]
    expected = [r.id for r in df.where("day = 0").orderBy(*order).limit(10).collect()]
    assert hot == expected
    assert top.groupBy("day").count().where("count <> 10").count() == 0


def test_hot_id_sends_one_row_per_task(spark):
    """A third of all rows are copies of one post; the shuffle sees one of them per map task."""
    df = spark.range(0, 30000, numPartitions=10).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
        .alias("id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("load_date"),
        F.col("id").alias("score"))
    out = dedup_latest(df)
    assert out.count() == 20001
    assert out.where("id = 'hot'").first().score == 29997
    plan = out._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Exchange hashpartitioning(id")
    assert "Final" in before and "Partial" in after


def test_large_k_is_limited_before_the_shuffle(spark):
    df = spark.range(0, 20000, numPartitions=8).select(
        F.col("id"), (F.col("id") % 2).alias("day"), ((F.col("id") * 7919) % 30011).alias("score"))
    order = [F.col("score").desc(), F.col("id").asc()]
    top = top_per_group(df, ["day"], order, 2000)
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4
    assert top.count() == 4000
    hot = [r.id for r in top.where("day = 0").orderBy(*order).collect()]
    assert hot == [r.id for r in df.where("day = 0").orderBy(*order).limit(2000).collect()]

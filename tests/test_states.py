"""States and incremental refresh: what is read, what is replaced, and equality with the marts."""

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from hearsay.functions.filters import post_date
from hearsay.operators import explore, graph, marts, states as st
from hearsay.plans import incremental
from hearsay.plans.incremental import read_kpis, refresh_dates
from hearsay.plans.layers import build_silver
from hearsay.scoring.enrich import enrich
from hearsay.sinks.tables import ensure_namespace, replace_dates, write_layer
from hearsay.sources.sample_posts import prose_scorers, sample_posts
from hearsay.sources.tables import read_layer
from tests.compare import spark_rows


@pytest.fixture(scope="module")
def gold(spark, sf_dir):
    from hearsay.session import shared_scratch
    path = shared_scratch(spark, "test-gold")
    enrich(build_silver(sample_posts(spark, sf_dir)), prose_scorers()).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def sums(spark, gold):
    placed = graph.kept(st.new_numbers(gold, spark.createDataFrame([], "author string, number long"), 1), "placed")
    numbers = st.numbered(placed)
    return st.post_states(gold).persist(), st.author_states(gold, numbers).persist(), numbers


def test_numbers_are_dense_and_unique(gold, sums):
    numbers = sorted(r["number"] for r in sums[2].collect())
    assert numbers == list(range(1, gold.select("author").where("author IS NOT NULL").distinct().count() + 1))


@pytest.mark.parametrize("name", ["sentiment_by_subreddit", "emotion_analysis", "daily_metrics"])
def test_marts_from_states_equal_those_from_posts(gold, sums, name):
    assert spark_rows(st.BUILDERS[name](*sums[:2])) == spark_rows(marts.BUILDERS[name](gold))


def test_states_of_parts_add_up(spark, gold, sums):
    """States of two halves, put together, give the marts of the whole: they merge."""
    halves = [gold.where(F.pmod(F.xxhash64("id"), F.lit(2)) == i) for i in (0, 1)]
    posts = st.post_states(halves[0]).unionByName(st.post_states(halves[1]))
    authors = st.author_states(halves[0], sums[2]).unionByName(st.author_states(halves[1], sums[2]))
    assert spark_rows(st.daily_metrics(posts, authors)) == spark_rows(marts.daily_metrics(gold))
    assert spark_rows(st.kpis(posts, authors)) == spark_rows(explore.kpis(gold))


@pytest.mark.parametrize("days, subs", [((5, 9), None), ((5, 9), ["src1", "src2"]), ((1, 2), ["nowhere"]), ((31, 31), None)])
def test_numbers_of_any_range(gold, sums, days, subs):
    start, end = (date(2024, 1, d) for d in days)
    assert spark_rows(st.kpis(*sums[:2], start, end, subs)) == spark_rows(explore.kpis(gold, start, end, subs))


def test_empty_and_null_rows(spark, gold):
    nothing, numbers = gold.limit(0), spark.createDataFrame([], "author string, number long")
    posts, authors = st.post_states(nothing), st.author_states(nothing, numbers)
    assert spark_rows(st.kpis(posts, authors)) == spark_rows(explore.kpis(nothing))
    assert all(b(posts, authors).count() == 0 for b in st.BUILDERS.values())
    blank = gold.limit(5).withColumns({c: F.lit(None).cast(gold.schema[c].dataType) for c in
                                       ("author", "subreddit", "topic", "emotion", "sentiment", "score")})
    posts, authors = st.post_states(blank), st.author_states(blank, numbers)
    assert spark_rows(st.daily_metrics(posts, authors)) == spark_rows(marts.daily_metrics(blank))
    assert st.topic_subreddits(posts).count() == 0


def test_daily_metrics_from_states_has_no_expand(sums):
    assert "Expand" not in st.daily_metrics(*sums[:2])._jdf.queryExecution().optimizedPlan().toString()


def files_of(spark, settings, layer):
    found = {}
    root = spark.sql(f"DESCRIBE EXTENDED {settings.table(layer)}").where("col_name = 'Location'").first()[1]
    for folder, _, names in os.walk(root.replace("file:", "")):
        for n in names:
            if n.endswith(".parquet"):
                found[os.path.join(folder, n)] = os.stat(os.path.join(folder, n)).st_mtime_ns
    return found


def test_only_changed_dates_are_read_and_replaced(spark, sf_dir, settings):
    posts = sample_posts(spark, sf_dir).where("created_at < DATE '2024-01-08'")
    day = date(2024, 1, 4)
    write_layer_all(spark, settings, posts)
    layers = ("silver", "gold", "post_states", "author_states")
    before = {n: files_of(spark, settings, n) for n in layers}
    kpis = read_kpis(spark, settings, day, day).first()
    changed = posts.withColumn("score", F.when(F.to_date("created_at") == F.lit(day), F.col("score") + 5).otherwise(F.col("score")))
    write_layer(changed, settings, "bronze")
    refresh_dates(spark, settings, [day], prose_scorers())
    for n in layers:
        after = files_of(spark, settings, n)
        other = {f: t for f, t in before[n].items() if f"post_date={day}" not in f}
        assert other.items() <= after.items() and len(other) < len(before[n])
        assert all(f"post_date={day}" in f for f in after.keys() - other.keys())
    now = read_kpis(spark, settings, day, day).first()
    assert now["total_score"] == kpis["total_score"] + 5 * kpis["total_posts"] and now["unique_authors"] == kpis["unique_authors"]
    gold = read_layer(spark, settings, "gold")
    for name in ("sentiment_by_subreddit", "emotion_analysis", "daily_metrics"):
        assert spark_rows(read_layer(spark, settings, name)) == spark_rows(marts.BUILDERS[name](gold.drop("post_date")))


def write_layer_all(spark, settings, posts):
    from hearsay.sinks.tables import ensure_namespace
    ensure_namespace(spark, settings)
    write_layer(posts, settings, "bronze")
    refresh_dates(spark, settings, None, prose_scorers())


def test_vanished_dates_go_and_repeats_change_nothing(spark, sf_dir, settings):
    posts = sample_posts(spark, sf_dir).where("created_at < DATE '2024-01-05'")
    write_layer_all(spark, settings, posts)
    write_layer(posts.where("created_at < DATE '2024-01-04'"), settings, "bronze")
    for _ in range(2):
        refresh_dates(spark, settings, [date(2024, 1, 4)], prose_scorers())
        days = {r[0] for r in read_layer(spark, settings, "daily_metrics").select("post_date").collect()}
        assert days == {date(2024, 1, 1) + timedelta(days=i) for i in range(3)}
        assert {r[0] for r in read_layer(spark, settings, "gold").select("post_date").distinct().collect()} == days


def test_a_layer_without_dates_is_refused(spark, sf_dir, settings):
    from hearsay.sinks.tables import ensure_namespace
    ensure_namespace(spark, settings)
    rows = spark.createDataFrame([(1, date(2024, 1, 1))], "id int, post_date date")
    rows.write.saveAsTable(settings.table("silver"))
    with pytest.raises(ValueError, match="not partitioned"):
        replace_dates(rows, settings, "silver", [date(2024, 1, 1)])


def test_a_plan_over_a_range_prunes_partitions(spark, sf_dir, settings):
    write_layer_all(spark, settings, sample_posts(spark, sf_dir).where("created_at < DATE '2024-01-04'"))
    plan = read_kpis(spark, settings, date(2024, 1, 2), date(2024, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(post_date") == 2


# -- subreddits that share authors ----------------------------------------------------------

def plain_similar(sets, least):
    out, names = {}, sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and both >= least * len(sets[a] | sets[b]):
                out[a, b] = both
    return out


@pytest.mark.parametrize("least", ["1/100", "1/3", "1/2", "4/5", "1"])
def test_similar_subreddits_are_those_of_all_pairs(spark, least):
    import random
    from fractions import Fraction
    rng, sets = random.Random(11), {}
    for i in range(60):
        if i % 4 == 0 or not sets:
            sets[f"s{i:02d}"] = {f"a{rng.randrange(150)}" for _ in range(rng.choice([1, 3, 10, 60]))} | {"bot"}
        else:  # a neighbour of an earlier one
            old = sets[rng.choice(sorted(sets))]
            sets[f"s{i:02d}"] = {a for a in old if rng.random() < 0.8} | {f"a{rng.randrange(150)}"}
    rows = [(s, a) for s, held in sets.items() for a in held]
    rows += [(None, "a1"), ("s01", None)] + rows[:20]
    members = graph.memberships(spark.createDataFrame(rows, "subreddit string, author string"))
    found = graph.kept(graph.similar_subreddits(members, Fraction(least)), "test-edges")
    want = plain_similar(sets, Fraction(least))
    assert {(r["a"], r["b"]): r["shared"] for r in found.collect()} == want and found.count() == len(want)
    root = {s: s for s in sets}
    for _ in sets:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["subreddit"]: r for r in graph.subreddit_graph(members, found).collect()}
    assert {s: r["community"] for s, r in got.items()} == root
    assert all(got[s]["authors"] == len(sets[s]) for s in sets)
    assert sum(r["neighbours"] for r in got.values()) == 2 * len(want)


def test_rare_authors_bring_few_candidates(spark):
    """A thousand subreddits share one author and nothing else: the shared one is in no prefix."""
    from fractions import Fraction
    rows = spark.range(1000).selectExpr("concat('s', id) AS subreddit", "explode(array('bot', concat('x', id), concat('y', id), concat('z', id))) AS author")
    index = graph.prefixes(rows, Fraction(1, 2))
    assert index.where("author = 'bot'").count() == 0
    assert graph.candidates(index, Fraction(1, 2)).count() == 0


def test_a_long_chain_is_one_community(spark):
    edges = spark.range(300).selectExpr("lpad(id, 4, '0') AS a", "lpad(id + 1, 4, '0') AS b", "1L AS shared", "0.5D AS jaccard")
    assert {r["community"] for r in graph.communities(edges).collect()} == {"0000"}
    assert graph.communities(edges.limit(0)).count() == 0


def test_bronze_by_date_gives_the_same_and_gathers_only_repeated_posts(spark, settings, sf_dir):
    """Singles of a bronze that keeps dates apart are written as they are read, without a shuffle."""
    posts = sample_posts(spark, sf_dir)
    ensure_namespace(spark, settings)
    write_layer(posts, settings, "bronze")
    refresh_dates(spark, settings, None, prose_scorers())
    plain = spark_rows(read_layer(spark, settings, "gold"))
    spark.sql(f"DROP TABLE {settings.table('bronze')}")
    replace_dates(posts.withColumn("post_date", post_date()), settings, "bronze", None)
    written = []
    original = incremental.replace_dates
    incremental.replace_dates = lambda df, s, layer, *a, **k: (written.append((layer, df, k)), original(df, s, layer, *a, **k))
    try:
        refresh_dates(spark, settings, None, prose_scorers())
    finally:
        incremental.replace_dates = original
    layer, df, how = written[0]
    assert layer == "silver" and how == {"gathered": True}
    above, below = df._jdf.queryExecution().executedPlan().toString().split("Union", 1)
    assert "REBALANCE" not in above and below.count("REBALANCE") == 1
    assert spark_rows(read_layer(spark, settings, "gold")) == plain
    refresh_dates(spark, settings, [date(2024, 1, 4)], prose_scorers())
    assert spark_rows(read_layer(spark, settings, "gold")) == plain

"""Texts that are scored before the latest copies are chosen."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearsay.checks.queries import queries
from hearsay.checks.tone import tone_scorer
from hearsay.plans.layers import build_silver, score_then_dedup
from hearsay.scoring.enrich import enrich
from hearsay.scoring.lexicon import score_allowed
from hearsay.sources.sample_posts import prose_scorers


def test_the_same_copies_are_scored(spark):
    """Copies that tie on time and score have other texts, so other labels."""
    rows = [(str(i % 40) if i % 11 else None, datetime(2024, 1, 1 + i % 2), i % 2, " t ", "." * (i % 7) + "?" * (i % 5) + " x")
            for i in range(400)]
    bronze = spark.createDataFrame(rows, "id string, load_date timestamp, score long, title string, selftext string")
    bronze = bronze.withColumn("author", F.lit("a"))
    score = lambda posts: enrich(posts, [tone_scorer()])
    kept = ("id", "tone", "tone_confidence")
    plain = score(build_silver(bronze, ("id", "title", "selftext"))).select(*kept)
    out = score_then_dedup(bronze, ("id", "title", "selftext"), score, kept)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, plain.collect())) and out.count() == 41


@pytest.mark.parametrize("name", ["subreddit_topics", "model_scores"])
def test_texts_are_read_and_dealt_once(spark, sf_dir, name):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "FileScan" in line and "text:string" in line.split("ReadSchema")[-1]]
    assert len(read) == 1


def test_each_allowed_label_is_looked_up_once(spark):
    scorer = prose_scorers()[2]
    df = spark.createDataFrame([("this tre sur", ["Gaming"]), ("ist", None), ("", [])], "text string, allowed array<string>")
    out = score_allowed(df, "allowed", scorer, "text")
    assert [r["topic"] for r in out.select("topic").limit(1).collect()] == ["Gaming"]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_contains(") == len(scorer.labels)

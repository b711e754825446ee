"""Add labels to posts with any mix of scorers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.text import combined_text
from hearsay.scoring.lexicon import (
    LexiconScorer, score_allowed, score_by_value, score_lexicons,
)
from hearsay.scoring.model import ModelScorer, score_models

Scorer = LexiconScorer | ModelScorer


def enrich(
    df: DataFrame, scorers: Sequence[Scorer], keep_errors: bool = False,
    partitions: int | None = None, where: Column | None = None,
) -> DataFrame:
    """All columns of ``df`` plus a label and a confidence per scorer.

    No shuffle, unless ``partitions`` spreads a frame that arrives in few large partitions
    before Python models see it. ``keep_errors`` also keeps ``<name>_error``, NULL where
    scoring worked. Rows that do not meet ``where`` get the labels of a blank text and cost no
    scoring.
    """
    if partitions is not None:
        df = df.repartition(partitions)
    text = combined_text() if where is None else F.when(where, combined_text())
    return _scored(df.withColumn("_text", text), scorers, keep_errors).drop("_text")


def _scored(df: DataFrame, scorers: Sequence[Scorer], keep_errors: bool) -> DataFrame:
    columns = df.columns
    lexicons = [s for s in scorers if isinstance(s, LexiconScorer)]
    models = [s for s in scorers if isinstance(s, ModelScorer)]
    out = score_lexicons(df, lexicons, "_text") if lexicons else df
    if models:
        out = out.withColumn("_models", score_models(models, F.col("_text")))
        out = out.withColumns({
            name: F.col(f"_models.{m.name}.{part}")
            for m in models
            for name, part in (
                (m.name, "label"), (f"{m.name}_confidence", "confidence"),
                (f"{m.name}_error", "error"),
            )
        })
    added = []
    for s in scorers:
        added += [s.name, f"{s.name}_confidence"] + ([f"{s.name}_error"] if keep_errors else [])
    return out.select(*columns, *added)


def enrich_by_language(
    df: DataFrame, lang: str, scorers: Mapping[str, LexiconScorer], other: LexiconScorer
) -> DataFrame:
    """``df`` plus the label and confidence of the scorer for each row's language."""
    timed = df.withColumn("_text", combined_text())
    return score_by_value(timed, lang, scorers, other, "_text").drop("_text")


def enrich_topics(df: DataFrame, choices: DataFrame, scorer: LexiconScorer) -> DataFrame:
    """``df`` plus a topic out of the list of its subreddit; any topic where it has none.

    ``choices`` has rows (subreddit, label). An ordinary join on subreddit: Spark broadcasts the
    lists, one row per subreddit, only if their size allows it.
    """
    lists = choices.groupBy("subreddit").agg(F.collect_set("label").alias("_allowed"))
    joined = df.withColumn("_text", combined_text()).join(lists, "subreddit", "left")
    out = score_allowed(joined, "_allowed", scorer, "_text")
    return out.select(*df.columns, scorer.name, f"{scorer.name}_confidence")


def rescore_changed(
    silver: DataFrame, gold: DataFrame, scorers: Sequence[Scorer], keep_errors: bool = False
) -> DataFrame:
    """Like ``enrich``, but posts already in ``gold`` with the same text keep their labels.

    ``gold`` must hold one row per id, labelled by the same scorers. Only ids, text hashes and
    labels of gold are joined; scorers get NULL, which costs them nothing, for posts they have
    seen. Worth it for slow models; word lists are cheaper than the join. Tables bucketed alike by id
    are joined without a shuffle.
    """
    labels = [c for s in scorers for c in (s.name, f"{s.name}_confidence")]
    known = gold.select(
        F.col("id").alias("_id"),
        F.xxhash64(combined_text()).alias("_hash"),
        *[F.col(c).alias(f"_old_{c}") for c in labels],
    )
    text = combined_text()
    joined = silver.join(known, F.col("id") == F.col("_id"), "left")
    joined = joined.withColumn("_known", F.xxhash64(text).eqNullSafe(F.col("_hash")))
    joined = joined.withColumn("_text", F.when(~F.col("_known"), text))
    fresh = _scored(joined, scorers, keep_errors)
    errors = [f"{s.name}_error" for s in scorers] if keep_errors else []
    return fresh.select(*silver.columns, *[
        F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in labels
    ], *errors)

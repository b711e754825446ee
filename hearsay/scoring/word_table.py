"""Scoring with a table of weighted words, of any size.

Texts become (post, word, count) rows in the map tasks; a join brings the weights, an aggregate adds them
up per (post, label). Spark broadcasts the table where its size check allows that and shuffles both
sides where not. Neither texts nor tables reach the driver, and no list is pasted into the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.text import is_blank
from hearsay.scoring.lexicon import CONFIDENCE_PLACES, WORD_SEPARATOR, _bind

PLACES = 6


def counted_words(text: Column) -> Column:
    """Array of (word, n): a text's distinct words in order, counted where the text is."""
    words = F.array_sort(F.filter(F.split(F.lower(text), WORD_SEPARATOR), lambda w: w != ""))

    def stretches(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(w))
        starts = F.filter(places, lambda i: (i == 1) | (F.element_at(w, i) != F.element_at(w, F.greatest(i - 1, F.lit(1)))))
        return _bind(starts, lambda s: F.transform(s, lambda at, j: F.struct(
            F.element_at(w, at).alias("word"), (F.coalesce(F.get(s, j + 1), F.size(w) + 1) - at).alias("n"))))

    none = F.expr("cast(array() as array<struct<word:string,n:int>>)")
    return _bind(words, lambda w: F.when(F.size(w) > 0, stretches(w)).otherwise(none))


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n): the words of every text with their number, without a shuffle. ``key`` must be
    one per row."""
    return df.select(key, F.explode(counted_words(F.col(text))).alias("w")).select(key, "w.word", "w.n")


def learn_words(marked: DataFrame, key: str, text: str, truth: str, least: int = 2) -> DataFrame:
    """(word, label, weight) learned from rows with a label in ``truth``: the logarithm of a word's
    share among a label's texts, against its share among all, for words in at least ``least`` texts.

    A word counts once per text; half a text is added to every count. Weights are rounded, so
    another engine finds the same ones.
    """
    known = marked.where(F.col(truth).isNotNull())
    seen = word_counts(known, key, text).join(known.select(key, F.col(truth).alias("label")), key)
    per = seen.groupBy("word").pivot("label").agg(F.count(F.lit(1)))
    texts = known.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("texts"))
    rows = per.unpivot("word", [c for c in per.columns if c != "word"], "label", "n").na.fill(0, ["n"])
    everywhere = seen.groupBy("word").agg(F.count(F.lit(1)).alias("everywhere")).where(F.col("everywhere") >= least)
    total = F.lit(known.count())
    share = (F.col("n") + 0.5) / (F.col("texts") + 1.0)
    overall = (F.col("everywhere") + 0.5) / (total + 1.0)
    return rows.join(everywhere, "word").join(texts, "label").select(
        "word", "label", F.round(F.log(share / overall), PLACES).alias("weight"))


def score_words(
    df: DataFrame, key: str, text: str, words: DataFrame, labels: tuple[str, ...], fallback: str, name: str,
    distinct: bool = True, bias: dict[str, float] | None = None,
) -> DataFrame:
    """``df`` plus ``<name>`` and ``<name>_confidence``.

    ``words`` has rows (word, label, weight). A label's logit is its bias plus the weights of the text's
    words, each once, or as often as it occurs without ``distinct``; the first of ``labels`` with the largest logit
    wins. Blank and NULL texts get ``fallback`` with confidence 0. ``key`` must be one per row.
    """
    often = F.lit(1) if distinct else F.col("n")
    weight = F.col("weight").cast("decimal(18,6)") * often  # exact sums, in any order
    sums = (word_counts(df, key, text).join(words, "word")
            .groupBy(key).pivot("label", list(labels)).agg(F.sum(weight)))
    bias = bias or {}
    logits = [F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(0.0)) + F.lit(float(bias.get(x, 0.0))) for x in labels]
    sums = sums.select(key, F.array(*logits).alias("_logits"))
    out = df.join(sums, key, "left").withColumn("_logits", F.coalesce(
        "_logits", F.array(*[F.lit(float(bias.get(x, 0.0))) for x in labels])))
    return out.withColumns(_results(labels, fallback, name, F.col(text))).drop("_logits")


def _results(labels: tuple[str, ...], fallback: str, name: str, text: Column) -> dict[str, Column]:
    blank, logits = is_blank(text), F.col("_logits")
    top = F.array_max(logits)
    spread = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    best = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(logits, top).cast("int"))
    return {name: F.when(blank, fallback).otherwise(best),
            f"{name}_confidence": F.when(blank, 0.0).otherwise(F.round(F.lit(1.0) / spread, CONFIDENCE_PLACES))}

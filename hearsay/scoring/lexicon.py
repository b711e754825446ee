"""Word-list scorer: words are counted in batches (``listed``), the rest is built-in functions.

A text is split into lower-case words. Every label owns a list of words; its logit is a bias
plus ``sharpness`` times the share of matched words that are its own. The softmax over the
logits gives the confidence, and the first label with the largest logit wins.

Shares make long and short texts comparable, so whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.text import is_blank
from hearsay.scoring.listed import count_listed

WORD_SEPARATOR = r"[^\p{L}]+"
CONFIDENCE_PLACES = 6


@dataclass(frozen=True)
class LexiconScorer:
    """Scores one kind of label (``name``) with word lists."""

    name: str
    words: Mapping[str, Sequence[str]]
    fallback: str
    bias: Mapping[str, float] = field(default_factory=dict)
    sharpness: float = 4.0

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(self.words)

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for words in self.words.values() for w in words})


COUNTS = "_counts"


def with_counts(df: DataFrame, scorers: Sequence[LexiconScorer], text: str) -> DataFrame:
    """Add the number of words the text has of every label of every scorer, one array for all. The text
    is split once for all scorers, and later steps see only these numbers."""
    lists = [words for s in scorers for words in s.words.values()]
    return df.withColumn(COUNTS, count_listed(F.col(text), lists))


def _counts_of(scorers: Sequence[LexiconScorer]) -> list[Column]:
    """For each scorer its part of the array."""
    sizes = [len(s.labels) for s in scorers]
    return [F.slice(COUNTS, 1 + sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def score_lexicons(df: DataFrame, scorers: Sequence[LexiconScorer], text: str) -> DataFrame:
    """Add ``<name>``, ``<name>_confidence`` and ``<name>_error`` for every scorer; all three are
    those of a blank text where the text is NULL."""
    keep = df.columns
    out = with_counts(df.withColumn("_blank", is_blank(F.col(text))), scorers, text)
    out = out.withColumns({
        f"_scored_{s.name}": F.when(
            F.col("_blank"),
            F.struct(F.lit(s.fallback).alias("label"), F.lit(0.0).alias("confidence")),
        ).otherwise(_scored(s, counts))
        for s, counts in zip(scorers, _counts_of(scorers))
    })
    results = []
    for s in scorers:
        results += [
            F.col(f"_scored_{s.name}.label").alias(s.name),
            F.col(f"_scored_{s.name}.confidence").alias(f"{s.name}_confidence"),
            F.lit(None).cast("string").alias(f"{s.name}_error"),
        ]
    return out.select(*keep, *results)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it.

    Steps in columns of their own would do the same until somebody filters on a label: pushing
    that filter down pastes every step into every mention of it, which multiplies.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _scored(s: LexiconScorer, counts: Column) -> Column:
    """Struct of label and confidence."""
    return _bind(
        counts,
        lambda counts: _bind(
            _logits(s, counts),
            lambda logits: _bind(F.array_max(logits), lambda top: _best(s, logits, top)),
        ),
    )


def _logits(s: LexiconScorer, counts: Column) -> Column:
    each = [counts[i] for i in range(len(s.labels))]
    matched = F.greatest(sum(each[1:], each[0]), F.lit(1))
    biases = [F.lit(float(s.bias.get(label, 0.0))) for label in s.labels]
    return _bind(
        matched,
        lambda m: F.array(*[b + F.lit(s.sharpness) * n / m for b, n in zip(biases, each)]),
    )


def _best(s: LexiconScorer, logits: Column, top: Column) -> Column:
    """First label with the largest logit, and its softmax."""
    names = F.array(*[F.lit(x) for x in s.labels])
    terms = [F.exp(logits[i] - top) for i in range(len(s.labels))]
    softmax = F.round(F.lit(1.0) / sum(terms[1:], terms[0]), CONFIDENCE_PLACES)
    label = F.element_at(names, F.array_position(logits, top).cast("int"))
    return F.struct(label.alias("label"), softmax.alias("confidence"))


def score_by_value(
    df: DataFrame, by: str, scorers: Mapping[str, LexiconScorer], other: LexiconScorer, text: str
) -> DataFrame:
    """Add a label and a confidence with the scorer that the value of column ``by`` names, such
    as one word list per language; ``other`` scores the rest, NULL included. All scorers share
    a name. The text is split once, and of the scorers one runs per row."""
    keep, every = df.columns, [*scorers.values(), other]
    out = with_counts(df.withColumn("_blank", is_blank(F.col(text))), every, text)
    *counts, others = _counts_of(every)
    scored = F.when(F.col("_blank"), F.struct(
        F.lit(other.fallback).alias("label"), F.lit(0.0).alias("confidence")))
    for (value, s), own in zip(scorers.items(), counts):
        scored = scored.when(F.col(by) == value, _scored(s, own))
    out = out.withColumn("_result", scored.otherwise(_scored(other, others)))
    return out.select(*keep, F.col("_result.label").alias(other.name),
                      F.col("_result.confidence").alias(f"{other.name}_confidence"))


def score_allowed(df: DataFrame, allowed: str, scorer: LexiconScorer, text: str) -> DataFrame:
    """Add a label and a confidence, with only the labels in the array column ``allowed`` in the
    running; all of them where it is NULL. An empty list gives the fallback."""
    keep, labels = df.columns, scorer.labels
    out = with_counts(df.withColumn("_blank", is_blank(F.col(text))), [scorer], text)
    usable = F.array(*[F.coalesce(F.array_contains(F.col(allowed), label), F.lit(True)) for label in labels])

    def counted(u: Column) -> Column:
        return F.array(*[F.when(u[i], F.get(COUNTS, F.lit(i))).otherwise(0) for i in range(len(labels))])

    # no label that is out can win: its logit lies far below any other
    result = _bind(usable, lambda u: _bind(counted(u), lambda n: _bind(
        F.transform(_logits(scorer, n), lambda x, i: F.when(u[i], x).otherwise(F.lit(-1e6))),
        lambda logits: _bind(F.array_max(logits), lambda top: _best(scorer, logits, top)))))
    none = F.struct(F.lit(scorer.fallback).alias("label"), F.lit(0.0).alias("confidence"))
    out = out.withColumn("_result", F.when(
        F.col("_blank") | (F.size(F.coalesce(F.col(allowed), F.array(F.lit("")))) == 0), none).otherwise(result))
    return out.select(*keep, F.col("_result.label").alias(scorer.name),
                      F.col("_result.confidence").alias(f"{scorer.name}_confidence"))

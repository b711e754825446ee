"""A scorer with two labels that is fitted to marked texts.

Distinct words are hashed to ``dims`` features; a logistic regression is fitted by Spark's own solver,
which sums gradients in the tasks and sees every marked row. The model is at most ``dims`` weights. It
scores as one built-in expression, without Python and without a shuffle, and is stored as a table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.functions.text import is_blank
from hearsay.scoring.lexicon import CONFIDENCE_PLACES, WORD_SEPARATOR
from hearsay.session import delete_path, shared_scratch

MODEL_SCHEMA = "name string, negative string, positive string, dims int, bias double, feature int, weight double"


def features(text: Column, dims: int) -> Column:
    """Numbers below ``dims`` of a text's distinct words."""
    words = F.filter(F.split(F.lower(text), WORD_SEPARATOR), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(dims))))


@dataclass(frozen=True)
class FittedScorer:
    """Tells ``positive`` texts from ``negative`` ones; blank texts get ``negative`` with confidence 0."""

    name: str
    negative: str
    positive: str
    bias: float
    weights: tuple[float, ...] = field(repr=False)

    @property
    def labels(self) -> tuple[str, str]:
        return self.negative, self.positive

    def probability(self, text: Column) -> Column:
        """Chance of ``positive`` as a built-in expression."""
        return self.chance(features(text, len(self.weights)))

    def chance(self, numbers: Column) -> Column:
        """The same from a text's ``features``."""
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")  # folded to a literal
        logit = F.aggregate(numbers, F.lit(self.bias), lambda acc, f: acc + F.element_at(weights, f + 1))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def score(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` plus ``<name>`` and ``<name>_confidence``; NULL and blank texts get the fallback."""
        chance = F.when(~is_blank(F.col(text)), self.probability(F.col(text)))
        likely = F.col("_chance") >= 0.5
        sure = F.round(F.greatest(F.col("_chance"), 1 - F.col("_chance")), CONFIDENCE_PLACES)
        return df.withColumn("_chance", chance).withColumns({
            self.name: F.when(likely, self.positive).otherwise(self.negative),
            f"{self.name}_confidence": F.coalesce(sure, F.lit(0.0)),
        }).drop("_chance")


#: Penalties that are tried, the strongest first.
STRENGTHS = (0.02, 0.01, 0.005, 0.0025)
#: One in so many texts is left out of the fits that the penalty is chosen by.
CHOOSING = 5


def choosing_fold(text: Column) -> Column:
    """Is the text one of those that the penalty is chosen by? Copies of a text are on the same side."""
    return F.pmod(F.xxhash64(F.lit("choose"), F.coalesce(text, F.lit(""))), F.lit(CHOOSING)) == 0


def fit_best(marked: DataFrame, text: str, positive: Column, name: str, labels: tuple[str, str],
             strengths: Sequence[float] = STRENGTHS, dims: int = 1 << 14, **settings) -> tuple[FittedScorer, dict[float, float]]:
    """``fit`` with the penalty that does best on texts its fit has not seen, and the F1 of each penalty.

    Every penalty is fitted to the rows outside ``choosing_fold`` and judged by the F1 of ``positive`` inside
    it; ties go to the stronger one. The model that is returned is fitted to all rows. Rows that are to
    judge this model must not be in ``marked``: neither weights nor penalty have then seen them.
    """
    found = numbered(marked, text, positive, dims).withColumn("choosing", choosing_fold(F.col("text")))
    path = shared_scratch(marked.sparkSession, "fit")
    found.drop("text").write.parquet(path)  # every fit reads numbers; texts are split once
    known = marked.sparkSession.read.schema(found.drop("text").schema).parquet(path)
    models = {s: fit_numbers(known.where("NOT choosing"), name, labels, dims, strength=s, **settings) for s in strengths}
    says = [~F.col("blank") & (m.chance(F.col("numbers")) >= 0.5) for m in models.values()]
    true = F.col("label") == 1
    counts = known.where("choosing").agg(
        F.count_if(true).alias("is"), *[F.count_if(x).alias(f"says{i}") for i, x in enumerate(says)],
        *[F.count_if(x & true).alias(f"both{i}") for i, x in enumerate(says)]).first()
    f1 = {s: 2 * counts[f"both{i}"] / max(counts["is"] + counts[f"says{i}"], 1) for i, s in enumerate(models)}
    best = max(f1, key=lambda s: (f1[s], s))
    model = fit_numbers(known, name, labels, dims, strength=best, **settings)
    delete_path(marked.sparkSession, path)
    return model, f1


def numbered(marked: DataFrame, text: str, positive: Column, dims: int) -> DataFrame:
    """(text, label, blank, numbers): the rows with a label, 1.0 or 0.0, and the ``features`` of their texts."""
    rows = marked.select(F.col(text).alias("text"), positive.cast("double").alias("label")).where("label IS NOT NULL")
    return rows.withColumns({"blank": is_blank(F.col("text")), "numbers": features(F.coalesce("text", F.lit("")), dims)})


def fit(marked: DataFrame, text: str, positive: Column, name: str, labels: tuple[str, str],
        dims: int = 1 << 14, strength: float = 0.005, rounds: int = 60) -> FittedScorer:
    """Fit to every row of ``marked``: ``positive`` says which label a row has, NULL leaves it out.

    Both labels weigh the same in total, however rare one is. The penalty is on absolute weights, so the
    words that tell nothing drop out. With one label only, the model says that label for every text.
    """
    return fit_numbers(numbered(marked, text, positive, dims), name, labels, dims, strength, rounds)


def fit_numbers(known: DataFrame, name: str, labels: tuple[str, str], dims: int, strength: float = 0.005,
                rounds: int = 60) -> FittedScorer:
    """``fit`` on rows of (label, numbers)."""
    rows = known.select(F.col("numbers").cast("array<string>").alias("words"), "label")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return FittedScorer(name, *labels, 1.0 if counts.get(1.0) else -1.0, (0.0,) * dims)
    every = sum(counts.values())
    weight = F.when(F.col("label") == 1, every / (2 * counts[1.0])).otherwise(every / (2 * counts[0.0]))
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(dims)], "words", "features")
    vectors = vectors.setBinary(True)
    learner = LogisticRegression(maxIter=rounds, regParam=strength, elasticNetParam=1.0, weightCol="weight",
                                 standardization=False)
    model = learner.fit(vectors.transform(rows.withColumn("weight", weight)).select("features", "label", "weight"))
    return FittedScorer(name, *labels, float(model.intercept), tuple(map(float, model.coefficients.toArray())))


def save_model(spark: SparkSession, scorer: FittedScorer, path: str) -> None:
    """Write a model's weights, at most its number of features, as a table."""
    rows = [(scorer.name, *scorer.labels, len(scorer.weights), scorer.bias, i, w)
            for i, w in enumerate(scorer.weights) if w or not i]
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> FittedScorer:
    """Read what ``save_model`` wrote."""
    rows = spark.read.schema(MODEL_SCHEMA).parquet(path).collect()  # at most the model's features
    weights = [0.0] * rows[0]["dims"]
    for r in rows:
        weights[r["feature"]] = r["weight"]
    return FittedScorer(rows[0]["name"], rows[0]["negative"], rows[0]["positive"], rows[0]["bias"], tuple(weights))

"""Quality classifier by Bradley-Terry ranking of preference pairs.

A pair holds a document labelled good and one labelled bad; the model learns weights whose score
difference predicts which one is preferred (logistic loss on feature differences). A quantile of
the training scores, the share of bad labels, becomes the threshold; scores are mapped to 0..1 so
that this threshold sits at ``CUT``. Features come from the whole text in one Arrow pass without a
shuffle. The fit takes every labelled row outside the held-out fold: pairs are drawn in buckets of rows, and
Spark's own solver sums their gradients in the tasks. Only weights and quantiles reach the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from hearsay.llm.common import held_out, quoted, stored

#: Rows of the rarer label that a bucket aims at, rows it may have in all, and pairs per row of the other label.
BUCKET, BUCKET_ROWS, PAIRS = 256, 1 << 16, 4
#: Buckets that one task of the solver takes, once there are more than the cores can hold.
TASK_BUCKETS = 64
#: Decimals of the fitted weights, so that the order in which tasks end does not show.
PLACES = 6
CUT = 0.3
SEED = 7
FEATURES = ("length", "distinct", "squeeze", "upper", "signs", "tails", "top_sign", "top_word",
            "runs", "word_length", "repeated_lines", "alien", "odd_length")
_SIGNS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def features(text: str | None) -> list[float]:
    """Shape of a text, no vocabulary: all zero for null, empty and blank texts."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    n, size = len(words), len(raw)
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    signs = np.where(_SIGNS, seen, 0)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    mean = sum(map(len, words)) / n
    tails = sum(map(str.isalnum, words)) / n
    return [
        float(np.log1p(n)), len(counts) / n ** 0.8, len(zlib.compress(raw, 1)) / (size + 40),
        upper / (upper + lower + 1), signs.sum() / size, 1 - tails, signs.max() / n,
        max(counts.values()) / n if n > 4 else 0.0, sum(map(eq, words, words[1:])) / n, mean / 10,
        1 - len(set(lines)) / max(1, len(lines)), (seen[128:].sum()) / size, abs(mean - 5) / 10,
    ]


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking; small, and sent to tasks inside the function that uses it."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return _expand((rows - self.centre) / self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0..1; the threshold scores ``CUT``."""
        margin = np.clip(self.raw(rows) - self.threshold, -30, 30)
        return 1 / (1 + np.exp(-(margin + np.log(CUT / (1 - CUT)))))


def _expand(z: np.ndarray) -> np.ndarray:
    """Clipped standard scores and their squares: junk may be too high or too low."""
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z / 4])


def fit_pairs(rows: DataFrame) -> Ranking:
    """Fit on stored rows (doc_id, _good, f). Without both labels nothing is preferred: weights
    stay zero and every score lies above ``CUT``."""
    width, good = 2 * len(FEATURES), F.col("_good")
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"),
        *[F.percentile_approx(F.when(good, F.col("f")[i]), 0.5, 10000).alias(f"c{i}") for i in range(len(FEATURES))],
        *[F.stddev_pop(F.when(good, F.col("f")[i])).alias(f"s{i}") for i in range(len(FEATURES))]).first()
    if one["good"] in (0, one["n"]):
        return Ranking(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(width), -1.0)
    centre = np.array([one[f"c{i}"] for i in range(len(FEATURES))])
    scale = np.round([one[f"s{i}"] for i in range(len(FEATURES))], 9) + 1e-3
    rarer = min(one["good"], one["n"] - one["good"])
    buckets = max(-(-rarer // BUCKET), -(-one["n"] // BUCKET_ROWS))

    def draw(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending")])
        z = _expand((_grid(group.column("f")) - centre) / scale)
        mark = group.column("_good").to_numpy()
        diff = pairs(z[mark], z[~mark]).reshape(-1, width)
        sign = np.where(np.arange(len(diff)) % 2, -1.0, 1.0)  # the solver wants both outcomes
        return pa.table({"label": (sign + 1) / 2, "diff": pa.array(list(diff * sign[:, None]), pa.list_(pa.float64()))})

    drawn = (rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "f"), F.lit(buckets))).groupBy("_bucket")
             .applyInArrow(draw, "label double, diff array<double>"))
    # every round of the solver is a job with a task per partition, so there are no more of them than cores, unless many buckets need them
    drawn = drawn.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, buckets // TASK_BUCKETS))
    solver = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-3, maxIter=100)
    model = solver.fit(drawn.select("label", array_to_vector("diff").alias("features")))
    weights = np.round(model.coefficients.toArray(), PLACES)
    ranking = Ranking(centre, scale, weights, 0.0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranking.raw(_grid(b.column(0))))], ["raw"])

    share = 1 - one["good"] / one["n"]
    cut = rows.select("f").mapInArrow(each, "raw double").agg(F.percentile_approx("raw", share, 100000)).first()[0]
    return Ranking(centre, scale, weights, cut)


def pairs(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Differences of drawn pairs: every row of both is in ``PAIRS`` of them or more; none if one is empty."""
    n = max(len(good), len(bad)) if len(good) and len(bad) else 0
    draw = np.random.default_rng(SEED)
    parts = [good[draw.permutation(len(good))[np.arange(n) % len(good)]] - bad[draw.permutation(len(bad))[np.arange(n) % len(bad)]]
             for _ in range(PAIRS if n else 0)]
    return np.concatenate(parts) if parts else np.zeros((0, good.shape[1]))


def _grid(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Feature rows of a column of lists."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``f``, the features of ``text``."""
    narrow = docs.select(*keep, "text")
    schema = narrow.drop("text").withColumn("f", F.lit(None).cast("array<double>")).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([features(t.as_py()) for t in b.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*keep, "f"])

    return narrow.mapInArrow(each, schema)


def fit(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on every labelled document outside the held-out fold.

    Null ids and labels are not used; a label that has no document is skipped, and repeated rows count
    once. Texts are not shuffled: their features are joined.
    """
    rows = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id")))
            .select("doc_id", (F.col("quality") == 1).alias("_good")).distinct())
    found = with_features(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), "doc_id").join(rows, "doc_id").distinct()
    return fit_pairs(stored(found.select("doc_id", "_good", "f"), "labelled-features"))


def scored(docs: DataFrame, model: Ranking, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted`` (1 if score >= CUT, else 0)."""
    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    kept = narrow.drop("text")
    names = [*kept.columns, "score"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(t.as_py()) for t in b.column(len(keep))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(model.score(rows))], names)

    out = narrow.mapInArrow(each, kept.withColumn("score", F.lit(0.0)).schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score",
                      F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Nulls, empty and blank texts have all-zero features and are scored like any other; repeated
    rows each get the same score; an empty table gives an empty result. Other columns are ignored,
    and no label, language, source or id is an input of a score.
    """
    out = scored(docs, fit(docs, labels), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be good, with their columns, whatever their names."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.select(*[quoted(c).alias(i) for c, i in zip(names, inner)], F.col("text"))
    kept = scored(plain, fit(docs, labels), *inner).filter("predicted = 1")
    return kept.select(*[F.col(i).alias(c) for c, i in zip(names, inner)])

"""Language identification with error-correcting output codes.

Each learned language has a codeword; one binary classifier per bit, a logistic regression over
hashed byte n-grams, predicts that bit. Decoding sums over the bits a loss weighted by how well
the bit's classifier separated the sample, and chooses the codeword of least loss; a small lead
over the second marks the answer as ambiguous. Scoring is one Arrow pass over whole texts without
a shuffle. The fit uses a bounded sample (``SAMPLE`` rows, shared evenly by the languages).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearsay.llm.common import held_out, quoted

SAMPLE = 1600
#: Slices of the hashes, by which the sample is bounded before it is sorted.
SLICES = 4096
SLOTS = 4096
SEED = 11
UNKNOWN = "und"
#: Ambiguous: the lead over the second codeword is under a twentieth of a unit of loss.
CLEAR = 1 / (1 + float(np.exp(-6 * 0.05)))
_LETTER = re.compile(r"[^\W\d_]")
PIECE = 1 << 20


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-byte n-grams of the lower-cased text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), "u1")
    total = np.zeros(SLOTS)
    for at in range(0, len(raw), PIECE):  # bounded memory; pieces overlap by two bytes
        a = raw[at:at + PIECE + 2].astype("u4")
        two = a[:-1] * np.uint32(257) + a[1:]
        three = two[:-1] * np.uint32(257) + a[2:]
        for codes in (a[:PIECE], two[:PIECE], three[:PIECE]):
            mixed = (codes * np.uint32(2654435761)) >> np.uint32(20)
            total += np.bincount(mixed, minlength=SLOTS)
    return np.sqrt(total / total.sum())


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages.

    Up to six languages get the exhaustive code of 2^(n-1) - 1 bits. More get random bits, of
    which the draw with the largest least distance is kept; its length follows log2(n).
    """
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        columns = [[1] + [1 if (c >> k) & 1 else -1 for k in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    draw, best, apart = np.random.default_rng(SEED), None, -1
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (n, 10 * (n - 1).bit_length()))
        if (np.abs(code.sum(0)) == n).any():
            continue
        least = (code.shape[1] - (code @ code.T - 2 * code.shape[1] * np.eye(n))).min()
        if least > apart:
            best, apart = code, least
    return best


@dataclass(frozen=True)
class Codes:
    """Fitted bit classifiers; a few hundred kB, sent to tasks inside the function."""

    names: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and a 0..1 score: 1 when the lead over the second is
        large, near 1/2 when two are equally near."""
        margin = np.clip(profiles @ self.weights + self.bias, -8, 8)
        loss = np.log1p(np.exp(-margin[:, None, :] * self.code[None])) @ self.trust
        loss = loss / self.trust.sum()
        order = np.sort(loss, axis=1)
        lead = np.full(len(loss), 8.0) if loss.shape[1] < 2 else order[:, 1] - order[:, 0]
        return loss.argmin(axis=1), 1 / (1 + np.exp(-6 * lead))


def fit_codes(profiles: np.ndarray, names: np.ndarray, rounds: int = 150) -> Codes | None:
    """Fit one logistic regression per bit; None without any row."""
    if not len(names):
        return None
    known, which, count = np.unique(names, return_inverse=True, return_counts=True)
    code = codewords(len(known))
    target = (code[which] + 1) / 2
    share = (1 / count)[which]
    share = (share / share.sum())[:, None]  # every language weighs the same
    rows = profiles.astype("f4", copy=False)
    weights, bias = np.zeros((SLOTS, code.shape[1]), "f4"), np.zeros(code.shape[1], "f4")
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for turn in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(rows @ weights + bias, -30, 30))) - target) * share
        step = (rows.T @ error.astype("f4")) + 1e-5 * weights
        first, second = 0.9 * first + 0.1 * step, 0.99 * second + 0.01 * step * step
        weights -= 0.3 * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-6)
        bias -= 2.0 * error.sum(0)
    agree = np.maximum(0, (rows @ weights + bias) * code[which])
    trust = ((agree > 0) * share).sum(0) ** 2 + 1e-3
    return Codes(tuple(map(str, known)), code, weights.astype("f8"), bias.astype("f8"), trust)


def _cutoffs(keys: DataFrame, share: int) -> DataFrame:
    """(lang, cutoff): a hash below which a language has at least ``share`` rows, if it has them, and not
    many more. Hashes are spread evenly, so slices of ``1 / SLICES`` of them hold about equal numbers."""
    part = F.shiftright("h", 64 - SLICES.bit_length() + 1)
    counts = keys.groupBy("lang", part.alias("part")).agg(F.count("*").alias("n"), F.max("h").alias("top"))
    upto = Window.partitionBy("lang").orderBy("part")
    before = F.sum("n").over(upto) - F.col("n")
    return (counts.withColumn("before", before).filter(F.col("before") < share)
            .groupBy("lang").agg(F.max("top").alias("cutoff")))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Codes | None:
    """Fit on at most ``sample`` rows of ``docs`` with a language, outside the held-out fold.

    Every language gives the same number of rows at most, those with the smallest hashes of
    their id. A bound on the hashes, from counts per slice of hashes, holds back all but about that
    many rows of a language before any are brought together.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                         & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = usable.select("lang").distinct().count()
    if not found:
        return None
    share = max(1, sample // found)
    keys = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    bounds = _cutoffs(keys, share)  # a row per language
    ids = (keys.join(F.broadcast(bounds) if found <= sample else bounds, "lang").filter(F.col("h") <= F.col("cutoff"))
           .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share)
           .select("doc_id", "lang").distinct())
    # at most ``sample`` narrow rows, a proven bound for the broadcast
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grid = [profile(t.as_py()).astype("f4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(grid, pa.binary())], ["doc_id", "lang", "grid"])

    got = (rows.mapInArrow(each, "doc_id long, lang string, grid binary")
           .orderBy(F.xxhash64("doc_id"), "lang", "grid").limit(2 * sample).toArrow())
    grid = np.empty((len(got), SLOTS), "f4")
    for i, row in enumerate(got["grid"]):
        grid[i] = np.frombuffer(row.as_buffer(), "f4")
    names = np.array(got["lang"].to_pylist())
    del got
    return fit_codes(grid, names)


def tagged(docs: DataFrame, model: Codes | None, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``lang_pred``, ``score`` and ``ambiguous``."""
    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    kept = narrow.drop("text")
    columns = [*kept.columns, "lang_pred", "score"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(len(keep))]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
            for at in range(0, len(real), 256):
                part = real[at:at + 256]
                best, score = model.decode(np.stack([profile(texts[i]) for i in part]))
                scores[part] = score
                for i, k in zip(part, best):
                    names[i] = model.names[k]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], columns)

    schema = kept.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    out = narrow.mapInArrow(each, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score",
                      ((F.col("score") < CLEAR) & (F.col("lang_pred") != UNKNOWN)).alias("ambiguous"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) per row of ``docs``.

    ``lang_pred`` is a language of the training rows, or ``und`` with score 0 where the text is
    null, has no letter, or no training row has a language. Repeated rows get the same answer; an
    empty table gives an empty result; other columns are ignored.
    """
    out = tagged(docs, fit(docs, sample), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose language is known and not ambiguous, with their columns, whatever their names."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.select(*[quoted(c).alias(i) for c, i in zip(names, inner)], F.col("text"))
    out = tagged(plain, fit(docs, sample), *inner)
    kept = out.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return kept.select(*[F.col(i).alias(c) for c, i in zip(names, inner)])

"""Batch-model scorer: any Python model behind an Arrow-batched UDF.

A model is loaded once per Python worker, which Spark reuses for many tasks, and gets texts in
batches; all models of an enrichment share one UDF, so a text is sent to Python once. Spark
partitions the work; this module only isolates failures, so one bad text does not spoil its batch.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

Predict = Callable[[Sequence[str]], Sequence[tuple[str, float]]]

_LOADED: dict[str, Predict] = {}


@dataclass(frozen=True)
class ModelScorer:
    """Scores one kind of label with ``load()``, which returns a batch predict function.

    ``window`` is a model's input limit in characters: longer texts are scored window by window
    and the mean confidences decide, so no part of a text is left out.
    """

    name: str
    labels: tuple[str, ...]
    fallback: str
    load: Callable[[], Predict]
    batch_size: int = 64
    window: int | None = None

    def column(self, text: Column) -> Column:
        """Struct of label, confidence and error (NULL when scored)."""
        return score_models([self], text)[self.name]


def _loaded(key: str, load: Callable[[], Predict]) -> Predict:
    """A model, loaded on first use in this worker."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def score_models(scorers: Sequence[ModelScorer], text: Column) -> Column:
    """Struct with a result struct per scorer, from one UDF."""
    chosen = tuple(scorers)
    # the pickled loader tells models apart, closures included
    keys = [hashlib.sha256(cloudpickle.dumps(s.load)).hexdigest() for s in chosen]
    result = "struct<label:string,confidence:double,error:string>"

    @F.pandas_udf(", ".join(f"`{s.name}` {result}" for s in chosen))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = [_loaded(k, s.load) for k, s in zip(keys, chosen)]
        for texts in batches:
            yield pd.DataFrame({
                s.name: score_batch(texts, m, s.fallback, s.batch_size, s.window).to_dict("records")
                for s, m in zip(chosen, models)
            })

    return run(text)


def score_batch(
    texts: pd.Series, predict: Predict, fallback: str, size: int, window: int | None = None
) -> pd.DataFrame:
    """Score the non-blank texts in slices of ``size``; a failing slice is retried one by one."""
    out = pd.DataFrame(
        {"label": fallback, "confidence": 0.0, "error": None}, index=texts.index, dtype=object
    )
    todo = texts[texts.notna() & (texts.str.strip() != "")]
    long = todo[todo.str.len() > window] if window else todo.iloc[:0]
    for at, text in long.items():
        out.loc[at, ["label", "confidence", "error"]] = _windows(predict, text, window, fallback, size)
    todo = todo.drop(long.index)
    for start in range(0, len(todo), size):
        part = todo.iloc[start:start + size]
        try:
            found = _checked(predict(list(part)), len(part))
        except Exception:
            found = [_one(predict, text, fallback) for text in part]
        out.loc[part.index, ["label", "confidence", "error"]] = pd.DataFrame(
            found, index=part.index, columns=["label", "confidence", "error"], dtype=object
        )
    return out.astype({"confidence": "float64"})


def _windows(predict: Predict, text: str, window: int, fallback: str, size: int) -> tuple:
    """The label with the largest mean confidence over all windows of a text."""
    parts = [text[i:i + window] for i in range(0, len(text), window)]
    total: dict[str, float] = defaultdict(float)
    try:
        for start in range(0, len(parts), size):
            some = parts[start:start + size]
            for label, confidence, _ in _checked(predict(some), len(some)):
                total[label] += confidence / len(parts)
    except Exception as problem:
        return fallback, 0.0, f"{type(problem).__name__}: {problem}"
    best = min(total, key=lambda label: (-total[label], label))
    return best, total[best], None


def _checked(found: Sequence[tuple[str, float]], expected: int) -> list[tuple]:
    rows = [(str(label), float(confidence), None) for label, confidence in found]
    if len(rows) != expected:
        raise ValueError(f"model returned {len(rows)} results for {expected} texts")
    return rows


def _one(predict: Predict, text: str, fallback: str) -> tuple:
    try:
        return _checked(predict([text]), 1)[0]
    except Exception as problem:
        return fallback, 0.0, f"{type(problem).__name__}: {problem}"

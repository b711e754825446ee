"""A tiny vectorised model that stands in for a real one when the model interface is checked."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from hearsay.scoring.model import ModelScorer

TONES = ("statement", "question", "exclamation")


def load_tone_model():
    """Predict from the numbers of full stops, question marks and exclamation marks."""
    def predict(texts: Sequence[str]) -> list[tuple[str, float]]:
        counts = np.array([[t.count(c) for c in ".?!"] for t in texts], dtype="float64") + 1.0
        shares = counts / counts.sum(axis=1, keepdims=True)
        best = shares.argmax(axis=1)
        top = shares[np.arange(len(best)), best]
        return [(TONES[i], float(c)) for i, c in zip(best, top)]

    return predict


def tone_scorer() -> ModelScorer:
    """The stand-in as a scorer."""
    return ModelScorer("tone", TONES, "statement", load_tone_model)

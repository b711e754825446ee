"""Label posts with sentiment, emotion and topic."""

from hearsay.scoring.enrich import enrich, rescore_changed
from hearsay.scoring.lexicon import LexiconScorer
from hearsay.scoring.model import ModelScorer

__all__ = ["LexiconScorer", "ModelScorer", "enrich", "rescore_changed"]

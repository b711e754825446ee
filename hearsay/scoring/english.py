"""Small English word lists: the default scorers.

They stand in for pre-trained models, which need weights this package does not ship. Plug a
real model in with ``ModelScorer``; its labels will differ from these.
"""

from __future__ import annotations

from hearsay.scoring.labels import (
    EMOTION_LABELS, FALLBACKS, SENTIMENT_LABELS, TOPIC_LABELS,
)
from hearsay.scoring.lexicon import LexiconScorer

SENTIMENT_WORDS = {
    "positive": (
        "amazing awesome beautiful best brilliant cute delicious enjoy excellent excited "
        "fantastic favorite fun glad good great happy incredible love nice perfect proud "
        "thank thanks win wonderful"
    ),
    "negative": (
        "angry annoying awful bad boring broken disappointed disgusting fail failed hate "
        "horrible lost pain poor sad scam stupid terrible ugly unfair useless worst worthless "
        "wrong"
    ),
}

EMOTION_WORDS = {
    "anger": "angry furious hate idiot mad outrage rage ridiculous stupid unfair",
    "disgust": "disgusting dirty filthy foul gross nasty rotten sick vile vomit",
    "fear": "afraid anxious danger fear nervous panic scared scary terrified worried",
    "joy": "awesome celebrate cute delighted excited fun glad happy joy love",
    "sadness": "alone crying depressed grief lonely loss miss sad sorry tears",
    "surprise": "amazed incredible shocked sudden suddenly surprise surprised unbelievable "
                "unexpected wow",
}

TOPIC_WORDS = {
    "Technology & Science": "ai app code computer physics science scientist software space study",
    "News & Politics": "congress country election government law news police president vote war",
    "Entertainment & Media": "actor album band episode film movie music series show song",
    "Gaming": "boss console game gamer gaming nintendo player playstation quest xbox",
    "Sports": "ball basketball championship coach football goal league match season team",
    "Health & Wellness": "doctor exercise fitness gym health hospital medicine sleep therapy yoga",
    "Education & Learning": "class college course degree exam learn school student teacher "
                            "university",
    "Business & Finance": "bank business company invest job market money price salary stock",
    "Art & Design": "art artist canvas color design drawing painting photo sculpture sketch",
    "Lifestyle & Personal": "birthday daily dress fashion home house life morning pet style",
    "Memes & Humor": "comedy funny haha hilarious humor joke laugh lol meme prank",
    "DIY & Crafts": "build built craft diy handmade knit paint repair sew wood",
    "Food & Cooking": "bake bread cake chicken cook dinner food meal recipe restaurant",
    "Travel & Places": "beach city flight hotel island mountain tourist train travel trip",
    "Relationships & Advice": "advice boyfriend breakup dating divorce friend girlfriend husband "
                              "marriage wife",
}


def _in_order(words: dict[str, str], labels: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    return {label: tuple(words.get(label, "").split()) for label in labels}


def default_scorers() -> tuple[LexiconScorer, ...]:
    """Sentiment, emotion and topic scorers for English posts."""
    return (
        LexiconScorer(
            "sentiment", _in_order(SENTIMENT_WORDS, SENTIMENT_LABELS), FALLBACKS["sentiment"],
            bias={"neutral": 1.0},
        ),
        LexiconScorer(
            "emotion", _in_order(EMOTION_WORDS, EMOTION_LABELS), FALLBACKS["emotion"],
            bias={"neutral": 1.0},
        ),
        topic_scorer(),
    )


def topic_scorer(labels: tuple[str, ...] = TOPIC_LABELS) -> LexiconScorer:
    """Topic scorer over a chosen list of topics; the list order breaks ties."""
    unknown = [x for x in labels if x not in TOPIC_WORDS]
    if unknown:
        raise ValueError(f"no words for topics: {unknown}")
    return LexiconScorer("topic", _in_order(TOPIC_WORDS, labels), FALLBACKS["topic"])

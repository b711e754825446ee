"""Label sets. Names, spelling and order must stay as they are."""

SENTIMENT_LABELS = ("negative", "neutral", "positive")

EMOTION_LABELS = ("anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise")

TOPIC_LABELS = (
    "Technology & Science",
    "News & Politics",
    "Entertainment & Media",
    "Gaming",
    "Sports",
    "Health & Wellness",
    "Education & Learning",
    "Business & Finance",
    "Art & Design",
    "Lifestyle & Personal",
    "Memes & Humor",
    "DIY & Crafts",
    "Food & Cooking",
    "Travel & Places",
    "Relationships & Advice",
)

# Label given, with confidence 0.0, to blank texts and to texts a scorer fails on.
FALLBACKS = {"sentiment": "neutral", "emotion": "neutral", "topic": "uncategorized"}

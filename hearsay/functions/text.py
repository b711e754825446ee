"""Predicates and text columns used when posts are cleaned and scored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The results depend on these exact patterns and thresholds.
BOT_PATTERN = r"(automoderator|bot|^\[deleted\]$|^\[removed\]$|moderator|automod)"
CHAR_RUN_PATTERN = r"(.)\1{10,}"
SPECIAL_CHARS = "!@#$%^&*()"
SPECIAL_CHARS_LIMIT = 10
HIGH_SCORE_LIMIT = 100000

# The same words as BOT_PATTERN, but standing alone: "robot" and "Abbott" are people.
STRICT_BOT_PATTERN = (
    r"(^|[^a-z0-9])(automoderator|bot|moderator|automod)([^a-z0-9]|$)"
    r"|^\[deleted\]$|^\[removed\]$"
)

# White space as Unicode defines it, plus the four separators that Python's strip() also drops.
NON_BLANK_PATTERN = r"(?U)[^\s\x1c-\x1f]"


def is_bot(author: Column, strict: bool = False) -> Column:
    """True for moderator and bot accounts; a missing author is not a bot."""
    pattern = STRICT_BOT_PATTERN if strict else BOT_PATTERN
    return F.coalesce(F.lower(author).rlike(pattern), F.lit(False))


def has_char_run(text: Column) -> Column:
    """The same character eleven or more times in a row."""
    return F.coalesce(text.rlike(CHAR_RUN_PATTERN), F.lit(False))


def has_many_special_chars(text: Column) -> Column:
    """More than ten characters out of ``SPECIAL_CHARS``."""
    kept = F.length(text) - F.length(F.translate(text, SPECIAL_CHARS, ""))
    return F.coalesce(kept > SPECIAL_CHARS_LIMIT, F.lit(False))


def has_high_score(score: Column) -> Column:
    """Score above ``HIGH_SCORE_LIMIT``."""
    return F.coalesce(score > HIGH_SCORE_LIMIT, F.lit(False))


def is_missing(value: Column) -> Column:
    """NULL, or nothing but spaces once written as a string."""
    return value.isNull() | (F.trim(value.cast("string")) == "")


def is_blank(text: Column) -> Column:
    """NULL, or nothing but white space of any kind."""
    return text.isNull() | ~text.rlike(NON_BLANK_PATTERN)


def combined_text(title: str = "title", body: str = "selftext") -> Column:
    """Title and body joined by one space, missing parts as empty strings."""
    empty = F.lit("")
    return F.concat_ws(" ", F.coalesce(F.col(title), empty), F.coalesce(F.col(body), empty))


def metric_key(kind: str, label: Column) -> Column:
    """``<kind>_<label>_count`` with blanks and ampersands replaced."""
    clean = F.replace(F.replace(label, F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    return F.concat(F.lit(f"{kind}_"), clean, F.lit("_count"))

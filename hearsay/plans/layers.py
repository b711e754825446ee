"""Bronze to silver to gold, as lazy frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.operators.clean import flag_bots, standardize
from hearsay.operators.dedup import dedup_latest, dedup_wide, repeated, wide_parts
from hearsay.scoring.enrich import Scorer, enrich
from hearsay.scoring.english import default_scorers

# Needed to choose the latest copy of a post.
DEDUP_COLUMNS = ("id", "load_date", "score")
#: Columns that make a row too wide to shuffle without need.
WIDE = {"selftext"}


def build_silver(
    bronze: DataFrame, columns: Sequence[str] | None = None, strict_bots: bool = False,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Trimmed, flagged, one row per post.

    ``columns`` narrows the frame before the shuffle that finds the latest copies; it decides
    what that shuffle carries. With texts in the frame only posts that come up more than once go through it;
    of whole posts ``keep`` chooses these, as in ``dedup_wide``.
    """
    flagged = bronze.transform(standardize).transform(flag_bots, strict_bots)
    if columns is None:
        return dedup_wide(flagged, keep=keep)
    needed = flagged.select(*dict.fromkeys([*DEDUP_COLUMNS, *columns]))
    found = dedup_wide(needed) if WIDE & set(columns) else dedup_latest(needed)
    return found.select(*columns)


def silver_parts(bronze: DataFrame, size: int) -> Iterator[DataFrame]:
    """``build_silver`` of bronze with ``size`` bytes of text, as frames to be written one after another."""
    flagged = bronze.transform(standardize).transform(flag_bots)
    return wide_parts(flagged, repeated(flagged), dedup_latest, size)


def build_gold(silver: DataFrame, scorers: Sequence[Scorer] | None = None) -> DataFrame:
    """Silver plus a label and a confidence per scorer."""
    return enrich(silver, scorers or default_scorers())


def label_then_dedup(
    bronze: DataFrame, columns: Sequence[str], scorers: Sequence[Scorer] | None = None,
    where: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """Columns of gold straight from bronze, for summaries that need labels but not texts.

    A label depends on the row's own text only, so labelling and choosing the latest copy can
    swap places. Texts are then dropped in the map tasks and the shuffle carries labels, at the
    price of also scoring the copies that lose. With slow models use the stored gold layer.

    A caller that keeps only some posts afterwards passes the same condition as ``where`` (a function of the cleaned frame): rows
    outside it still compete for being the latest copy, but are not scored.
    """
    flagged = bronze.transform(standardize).transform(flag_bots)
    labelled = enrich(
        flagged, scorers or default_scorers(), where=where(flagged) if where else None)
    needed = list(dict.fromkeys([*DEDUP_COLUMNS, *columns]))
    return dedup_latest(labelled.select(*needed)).select(*columns)


def score_then_dedup(
    bronze: DataFrame, columns: Sequence[str], score: Callable[[DataFrame], DataFrame], kept: Sequence[str],
) -> DataFrame:
    """``score(build_silver(bronze, columns)).select(kept)``, of every post the same copy, with texts read once
    and never shuffled. ``score`` must add columns row by row; it also gets the copies that lose.

    Copies that tie are ranked by the hash that ``build_silver`` ranks them by, taken while the texts are there.
    """
    flagged = bronze.transform(standardize).transform(flag_bots)
    needed = flagged.select(*dict.fromkeys([*DEDUP_COLUMNS, *columns]))
    scored = score(needed.withColumn("_tie", F.xxhash64(*needed.columns)))
    narrow = scored.select(*dict.fromkeys([*DEDUP_COLUMNS, "_tie", *kept]))
    return dedup_latest(narrow, order=(*DEDUP_COLUMNS[1:], "_tie")).select(*kept)

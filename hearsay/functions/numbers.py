"""Rounding rules for reported numbers.

Confidences are averaged as decimals: a decimal sum does not depend on the order in which
tasks finish, so a rerun on another cluster reports the same third digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE_TYPE = "decimal(7,6)"


def avg_to(value: str | Column, places: int) -> Column:
    """Average rounded half up."""
    return F.round(F.avg(value), places)


def ratio_to(part: Column, whole: Column, places: int) -> Column:
    """``part / whole`` rounded half up; NULL when ``whole`` is zero."""
    return F.round(F.try_divide(part, whole), places)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals; NULL when ``whole`` is zero."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), 2)


def confidence(name: str) -> Column:
    """A confidence column as an exact decimal."""
    return F.col(name).cast(CONFIDENCE_TYPE)


def avg_confidence(name: str) -> Column:
    """Average confidence with three decimals."""
    return F.round(F.avg(confidence(name)), 3).cast("double")


def exact_avg_confidence(name: str) -> Column:
    """Average confidence, not rounded."""
    return F.try_divide(F.sum(confidence(name)).cast("double"), F.count(name))


def total(value: str) -> Column:
    """Sum that is zero on empty input."""
    return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))

"""Frames with texts in rounds, so that a shuffle holds a share of them at a time.

A shuffle keeps all its rows on disk until it has been read. Work that treats each id by itself can be done
for the ids of one round after those of another: the rows are the same, and what each round shuffled is
gone before the next begins. Every round reads the source again, so small frames are one round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Bytes of text of a round, and how many rounds there are at most.
ROUND_BYTES, MOST_ROUNDS = 2 << 30, 8


def text_bytes(df: DataFrame) -> Column:
    """Bytes of the strings of a row."""
    names = [f.name for f in df.schema if isinstance(f.dataType, t.StringType)]
    return sum((F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)).cast("long") for n in names), F.lit(0).cast("long"))


def rounds_of(size: int | None) -> int:
    """Rounds for so many bytes of text."""
    return max(1, min(MOST_ROUNDS, math.ceil((size or 0) / ROUND_BYTES)))


def rounds_for(df: DataFrame) -> int:
    """Rounds for a frame, which is read for it."""
    return rounds_of(df.agg(F.sum(text_bytes(df))).first()[0])


def in_rounds(df: DataFrame, rounds: int, key: str = "id") -> list[DataFrame]:
    """``df`` by a hash of the key: every row is in one of the frames, and equal keys, NULL too, are together."""
    at = F.pmod(F.xxhash64(F.lit(3), F.col(key).cast("string")), F.lit(rounds))
    return [df] if rounds == 1 else [df.where(at == i) for i in range(rounds)]

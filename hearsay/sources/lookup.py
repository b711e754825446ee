"""Rows of stored Parquet by id, without reading the rest.

Files written with ``id_filters`` carry a Bloom filter of the ids in every row group. A reader that asks
for at most ``LOOKUP_IDS`` ids has Parquet test them there and skips the row groups that hold none, so a
look-up costs filters and the groups that hold its rows, whatever the size of the folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of one look-up. With more, false positives would open most row groups; a join is cheaper then.
LOOKUP_IDS = 256
#: Chance that a filter takes an id for present; some 24 bits a row.
FALSE_POSITIVES = 1e-4
#: Spark pushes longer lists of values as a range, which no Bloom filter can test.
PUSHED_VALUES = "spark.sql.parquet.pushdown.inFilterThreshold"


def id_filters(column: str = "id") -> dict[str, str]:
    """Parquet writer options for Bloom filters on ``column``, sized by the ids a row group holds. A
    dictionary of distinct ids would only be a second copy of them."""
    return {
        f"parquet.bloom.filter.enabled#{column}": "true",
        f"parquet.bloom.filter.fpp#{column}": str(FALSE_POSITIVES),
        "parquet.bloom.filter.adaptive.enabled": "true",
        "parquet.bloom.filter.max.bytes": str(8 << 20),
        f"parquet.enable.dictionary#{column}": "false",
    }


@contextmanager
def values_pushed(spark: SparkSession) -> Iterator[None]:
    """Push lists of up to ``LOOKUP_IDS`` values one by one; the setting is restored after. Frames have to
    be planned and run inside."""
    before = spark.conf.get(PUSHED_VALUES)
    spark.conf.set(PUSHED_VALUES, str(max(LOOKUP_IDS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(PUSHED_VALUES, before)


def with_ids(df: DataFrame, ids: Sequence, column: str = "id") -> DataFrame:
    """Rows of ``df`` whose id is one of ``ids``; NULL is never found. Row groups are skipped if the frame
    runs inside ``values_pushed``; the rows are the same in any case."""
    return df.where(F.col(column).isin([i for i in ids if i is not None]))


def few_at_a_time(counts: Mapping[date | None, int], limit: int = LOOKUP_IDS) -> list:
    """The keys with the fewest rows that have at most ``limit`` together. Ties go by key, NULL last."""
    chosen, total = [], 0
    for key in sorted(counts, key=lambda k: (counts[k], k is None, str(k))):
        total += counts[key]
        if total > limit:
            break
        chosen.append(key)
    return chosen

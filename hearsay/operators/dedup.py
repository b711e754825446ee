"""Keep one row per post."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.operators.rounds import in_rounds, rounds_of, text_bytes


def dedup_latest(
    df: DataFrame, key: str = "id", order: Sequence[str] = ("load_date", "score")
) -> DataFrame:
    """The latest row of every key.

    Rows that tie on ``order`` are ranked by a hash of all columns given, so the result does
    not depend on task order. ``row_number() = 1`` is planned with a limit on both sides of
    the shuffle: each map task sends at most one row per key, however many copies a hot key
    has. Narrow the frame before this call where later steps need few columns; the shuffle
    carries whatever is left.
    """
    ranking = Window.partitionBy(key).orderBy(
        *[F.col(c).desc() for c in order], F.col("_row_hash").desc()
    )
    return (
        df.withColumn("_row_hash", F.xxhash64(*[F.col(c) for c in df.columns]))
        .withColumn("_rank", F.row_number().over(ranking))
        .where(F.col("_rank") == 1)
        .drop("_row_hash", "_rank")
    )


#: Bits of the map of ids that ``split_by_ids`` broadcasts, as a power of two, and the rows it is made of at most.
MAP_BITS = 26
MAP_WORDS = 1 << (MAP_BITS - 6)


def _place(key: str) -> Column:
    """The bit of a key in the map; NULL has one too."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << MAP_BITS))


def split_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(free, suspect): ``suspect`` has every row whose key is in ``ids``, NULL included, and a few others;
    ``free`` has the rest, none of whose keys is in ``ids``.

    Neither side is shuffled. The keys become a map of bits, at most ``MAP_WORDS`` rows of two longs whatever
    their number, a proven bound for the broadcast. Keys that share a bit only make ``suspect`` larger, so
    callers must treat it by the exact rule.
    """
    return _split(df, _map_of(ids, key), key)


def _map_of(ids: DataFrame, key: str) -> DataFrame:
    return ids.select(_place(key).alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_bits"))


def _split(df: DataFrame, bits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("_at", _place(key)).withColumn("_word", F.shiftright("_at", 6)).join(
        F.broadcast(bits), "_word", "left")
    hit = F.coalesce(F.getbit("_bits", F.col("_at") % 64) == 1, F.lit(False))
    return tuple(marked.where(c).select(*map(_named, df.columns)) for c in (~hit, hit))


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def repeated(df: DataFrame, key: str = "id") -> DataFrame:
    """The keys that come up more than once; only this column is read and shuffled."""
    return df.select(key).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)


def dedup_wide(
    df: DataFrame, key: str = "id", keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``dedup_latest``, or another choice ``keep`` of one row per key, for rows that carry texts.

    A row whose key comes up once stays and is not shuffled. The frame is read three times, once for the
    keys alone; ``df`` has to give the same rows each time.
    """
    single, several = split_by_ids(df, repeated(df, key), key)
    return single.unionByName((keep or (lambda rows: dedup_latest(rows, key)))(several))


def wide_parts(
    df: DataFrame, ids: DataFrame, keep: Callable[[DataFrame], DataFrame], size: int, key: str = "id",
) -> Iterator[DataFrame]:
    """``free`` and ``keep(suspect)`` of ``split_by_ids`` as frames to be written one after another, one if
    ``df``, which has ``size`` bytes of text, is small. ``keep`` treats each key by itself. The map of bits is made once.
    """
    if rounds_of(size) == 1:
        free, suspect = split_by_ids(df, ids, key)
        yield free.unionByName(keep(suspect))
        return
    bits = _map_of(ids, key).persist()  # as small as the broadcast
    try:
        free, suspect = _split(df, bits, key)
        several = suspect.agg(F.sum(text_bytes(suspect))).first()[0] or 0
        for part in in_rounds(suspect, rounds_of(several), key):
            yield keep(part)
        yield from in_rounds(free, rounds_of(size - several), key)
    finally:
        bits.unpersist()

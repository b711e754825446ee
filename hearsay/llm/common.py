"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearsay.session import shared_scratch

#: The bytes that separate words, as a class for Java's and Python's regex.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``row``: helper columns beside it can't clash with them.
    ``select("row.*")`` brings them back."""
    return F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row")


def held_out(key: Column) -> Column:
    """Is the row in the held-out fold? A null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: later steps survive a lost executor and run
    the work before this point once."""
    path = shared_scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than white space; null counts 0."""
    runs = F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+"))
    return F.coalesce(runs, F.lit(0)).cast("long")


def slots(spark: SparkSession) -> int:
    """Partitions for steps whose cost does not follow their bytes, which adaptive execution
    would otherwise merge into a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               2 * spark.sparkContext.defaultParallelism)

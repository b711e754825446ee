"""Raw submissions, stored as monthly parquet folders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from hearsay.session import path_exists

# The columns later steps touch. Raw files may hold more; they are kept when no schema is given.
SUBMISSION_SCHEMA = t.StructType([
    t.StructField("id", t.StringType()),
    t.StructField("author", t.StringType()),
    t.StructField("subreddit", t.StringType()),
    t.StructField("title", t.StringType()),
    t.StructField("selftext", t.StringType()),
    t.StructField("score", t.LongType()),
    t.StructField("num_comments", t.LongType()),
    t.StructField("created_at", t.TimestampNTZType()),
    t.StructField("created_utc", t.LongType()),
    t.StructField("url", t.StringType()),
    t.StructField("over_18", t.BooleanType()),
    t.StructField("link_flair_text", t.StringType()),
    t.StructField("author_flair_text", t.StringType()),
])


def months_between(first: date, last: date) -> list[tuple[int, int]]:
    """(year, month) of every month touched by ``[first, last]``."""
    start, stop = first.year * 12 + first.month - 1, last.year * 12 + last.month - 1
    return [(m // 12, m % 12 + 1) for m in range(start, stop + 1)]


WHOLE = ("tinyint", "smallint", "int", "bigint")


def widest(one: t.DataType, other: t.DataType) -> t.DataType:
    """The narrowest type that keeps every value of both: the longer of two whole or two floating
    types, a double for a double and what fits in it, a timestamp for a date and a timestamp, and
    text for all else."""
    if one == other or isinstance(other, t.NullType):
        return one
    if isinstance(one, t.NullType):
        return other
    names = {one.simpleString(), other.simpleString()}
    if names <= set(WHOLE):
        return max(one, other, key=lambda x: WHOLE.index(x.simpleString()))
    if names <= {"float", "double", *WHOLE[:3]}:
        return t.DoubleType()
    if "date" in names and names <= {"date", "timestamp", "timestamp_ntz"}:
        return other if one.simpleString() == "date" else one
    return t.StringType()


def reconciled(months: list[DataFrame]) -> DataFrame:
    """All rows of frames whose columns may differ in type or be absent, each column in the widest of
    its types. Casts are plain projections over each month's scan, so columns are still pruned."""
    kinds: dict[str, t.DataType] = {}
    for df in months:
        for f in df.schema:
            kinds[f.name] = widest(kinds[f.name], f.dataType) if f.name in kinds else f.dataType

    def cast(df: DataFrame) -> DataFrame:
        held = {f.name: f.dataType for f in df.schema}
        return df.select(*[F.col(f"`{c}`") if held.get(c) == k else
                           (F.col(f"`{c}`") if c in held else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    whole = cast(months[0])
    for df in months[1:]:
        whole = whole.unionByName(cast(df))
    return whole


def read_submissions(
    spark: SparkSession, root: str, first: date, last: date | None = None,
    layout: str = "path", schema: t.StructType | None = None,
) -> DataFrame:
    """Submissions of the months touched by ``[first, last]`` (one month by default).

    ``layout="path"`` reads ``root/YYYY/MM``; ``layout="hive"`` reads ``root/year=…/month=…``
    and leaves the choice of folders to partition pruning. Either way no other month is read.
    Without a schema the columns of all months are read, NULL where a month lacks one. Months in
    folders of their own may differ in a column's type; the column then gets the narrowest type that
    holds the values of all. A month that is not there holds no posts; only a missing root is an error.
    """
    months = months_between(first, last or first)
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    base = root.rstrip("/")
    if layout == "path":
        if not path_exists(spark, base):
            raise FileNotFoundError(base)
        there = [p for p in (f"{base}/{y}/{m:02d}" for y, m in months) if path_exists(spark, p)]
        if not there:
            return spark.createDataFrame([], schema or SUBMISSION_SCHEMA)
        return reader.parquet(*there) if schema is not None else reconciled([spark.read.parquet(p) for p in there])
    if layout != "hive":
        raise ValueError(f"unknown layout: {layout}")
    wanted = [(F.col("year") == y) & (F.col("month") == m) for y, m in months]
    condition = wanted[0]
    for other in wanted[1:]:
        condition = condition | other
    return reader.parquet(base).where(condition).drop("year", "month")

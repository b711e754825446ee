"""Table writers. One writer per table: plain parquet overwrites are not atomic for readers.

With ``Settings.generations`` a layer is a view, and every rewrite a new table that the view is switched
to when it is complete. Readers see the old rows or the new ones, a failed run changes nothing, and a
rewrite may read the layer it replaces. The generation before the current one is kept for readers that
still run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hearsay.config import COMPACT, Settings
from hearsay.functions.filters import post_date
from hearsay.operators.rounds import in_rounds
from hearsay.session import frees_shuffles, partitions_open
from hearsay.sources.tables import Progress, layer_exists, read_layer

DAY_COLUMN = "load_day"
GENERATION, GENERATION_OF = "__generation_", "hearsay.generation"
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def ensure_namespace(spark: SparkSession, settings: Settings) -> None:
    """Create the namespace, with its comment, unless it is there."""
    comment = settings.comment.replace("'", "''")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {settings.namespace} COMMENT '{comment}'")


@contextmanager
def only_partitions_written(spark: SparkSession) -> Iterator[None]:
    """Let an overwrite replace just the partitions it writes. ``insertInto`` takes this from
    the session and ignores it as a writer option."""
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def write_days(df: DataFrame, settings: Settings) -> None:
    """Write bronze rows that carry ``load_day``, replacing the days they hold and no others.

    A repeated load of a day therefore leaves the same table. A failed write is an error; it
    never turns into an overwrite of the whole table.
    """
    spark, table = df.sparkSession, settings.table("bronze")
    # One day is a small file; many days are split by size, so a large day may use many files.
    rows = df.hint("rebalance", F.col(DAY_COLUMN))
    if not layer_exists(spark, settings, "bronze"):
        rows.write.options(**COMPACT).partitionBy(DAY_COLUMN).format("parquet").saveAsTable(table)
        return
    _add_columns(spark, table, rows)
    known = set(rows.columns)
    aligned = [F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name)
               for f in spark.table(table).schema]
    with only_partitions_written(spark):
        rows.select(*aligned).write.insertInto(table, overwrite=True)


def _add_columns(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Give the table the columns that turn up for the first time; older days read NULL."""
    stored = set(spark.table(table).columns)
    new = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in stored]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(new)})")
        spark.catalog.refreshTable(table)


def drop_empty_days(
    spark: SparkSession, settings: Settings, rows: DataFrame, first: date, last: date
) -> None:
    """Remove the stored days of ``[first, last]`` for which ``rows`` holds nothing. Only dates
    reach the driver."""
    stored = read_layer(spark, settings, "bronze").select(DAY_COLUMN).distinct()
    stored = stored.where(F.col(DAY_COLUMN).between(F.lit(first), F.lit(last)))
    held = {r[0] for r in rows.select(DAY_COLUMN).distinct().collect()}
    for (day,) in stored.collect():
        if day not in held:
            _drop_day(spark, settings, day)


def _drop_day(spark: SparkSession, settings: Settings, day: date) -> None:
    spark.sql(
        f"ALTER TABLE {settings.table('bronze')} "
        f"DROP IF EXISTS PARTITION ({DAY_COLUMN} = DATE '{day.isoformat()}')"
    )


def write_day(df: DataFrame, settings: Settings, day: date) -> None:
    """Write one day's rows; a day that came back empty on a rerun is removed."""
    rows = df.withColumn(DAY_COLUMN, F.lit(day)).persist()  # at most the posts of one day's top-k
    write_days(rows, settings)
    if rows.isEmpty() and layer_exists(df.sparkSession, settings, "bronze"):
        _drop_day(df.sparkSession, settings, day)
    rows.unpersist()


def reset_month(spark: SparkSession, settings: Settings) -> None:
    """Empty bronze."""
    if layer_exists(spark, settings, "bronze"):
        spark.sql(f"TRUNCATE TABLE {settings.table('bronze')}")


def write_progress(spark: SparkSession, settings: Settings, state: Progress) -> None:
    """Replace the state row."""
    state.to_frame(spark).coalesce(1).write.mode("overwrite").format("parquet").saveAsTable(
        settings.table("progress")
    )


def advance_progress(spark: SparkSession, settings: Settings, state: Progress) -> Progress:
    """Store the day after ``state`` as the next one to load."""
    following = state.after()
    write_progress(spark, settings, following)
    return following


def laid_out(
    df: DataFrame, by_post_date: bool = False, cluster_by: Sequence[str] = (),
    partitions: int | None = None, interleave: bool = False,
) -> DataFrame:
    """Arrange rows for the files they are written to.

    ``by_post_date`` gathers each date in few files. ``cluster_by`` sorts rows by range, so
    that file and row-group statistics let readers skip; the id is the last range key, which
    splits a value that holds a large share of all rows over many files. With ``interleave`` the columns
    count alike: the first key is ``interleaved``, so a filter on any of them alone skips files.
    """
    if by_post_date:
        df = df.withColumn("post_date", post_date())
    days = ["post_date"] if by_post_date else []
    if cluster_by:
        first = [interleaved(df, cluster_by)] if interleave else []
        keys = [*map(F.col, days), *first, *map(F.col, (*cluster_by, "id"))]
        ranged = (
            df.repartitionByRange(*keys) if partitions is None
            else df.repartitionByRange(partitions, *keys)
        )
        return ranged.sortWithinPartitions(*keys)
    if by_post_date:
        return df.hint("rebalance", F.col("post_date"))
    return df


#: Rows and steps from which the ranges of a clustered column are found; they only shape the files.
RANGE_SAMPLE, RANGE_BITS = 10_000, 6


def interleaved(df: DataFrame, columns: Sequence[str]) -> Column:
    """One sort key of several columns: the bits of their range numbers, in turns.

    A column's values are cut into 2 ** ``RANGE_BITS`` ranges of about equal numbers of rows, by the
    ``RANGE_SAMPLE`` rows with the smallest hashes of their id. NULL comes first.
    """
    sample = df.select("id", *columns).orderBy(F.xxhash64("id")).limit(RANGE_SAMPLE).select(*columns).collect()
    key, steps = F.lit(0).cast("long"), 1 << RANGE_BITS
    for j, c in enumerate(columns):
        held = sorted(r[c] for r in sample if r[c] is not None)
        ends = sorted({held[len(held) * i // steps] for i in range(1, steps)}) if held else []
        bounds = F.array(*map(F.lit, ends)) if ends else None
        number = F.lit(0) if bounds is None else F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(c))) + 1, F.lit(0))
        number = F.least(F.when(F.col(c).isNull(), 0).otherwise(number), F.lit(steps - 1)).cast("long")
        for i in range(RANGE_BITS):
            bit = F.shiftright(number, i).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bit, i * len(columns) + j))
    return key


BUCKETED = ("silver", "gold")


@frees_shuffles
def write_layer(
    df: DataFrame, settings: Settings, layer: str, by_post_date: bool = False,
    cluster_by: Sequence[str] = (), partitions: int | None = None,
    tally: Mapping[str, Column] | None = None, drop: Sequence[str] = (), interleave: bool = False, rounds: int = 1,
) -> dict[str, int]:
    """Replace a layer's rows and schema; returns ``rows`` and the other counts asked for.

    Rows are counted in the tasks that write them, so the frame is not computed twice and a
    retried task counts once. ``drop`` removes helper columns after the ``tally``. In ``rounds`` by id, which
    each lay out their rows and add them, a shuffle holds a share of the texts; ``df`` must not read the table then.

    With ``Settings.buckets`` silver and gold are bucketed and sorted by id instead of clustered: what is
    joined by id reads both without a shuffle. A task writes one bucket, so these are written in one round.
    """
    counts = {"rows": F.count(F.lit(1)), **(tally or {})}
    buckets = settings.buckets if layer in BUCKETED else 0
    table = settings.table(layer)
    fresh = f"{table}{GENERATION}{uuid.uuid4().hex}" if settings.generations else table
    written = dict.fromkeys(counts, 0)
    for n, part in enumerate(in_rounds(df, 1 if buckets else rounds)):
        if buckets:
            rows = laid_out(part, by_post_date).repartition(buckets, "id")
            rows = rows.sortWithinPartitions(*(["post_date"] if by_post_date else []), "id")
        else:
            rows = laid_out(part, by_post_date, cluster_by, partitions, interleave)
        seen = Observation(f"write_{layer}")
        writer = (
            rows
            .observe(seen, *[c.alias(name) for name, c in counts.items()])
            .drop(*drop)
            .write.mode("append" if n else "overwrite").options(**COMPACT).format("parquet")
        )
        if by_post_date:
            writer = writer.partitionBy("post_date")
        if buckets:
            writer = writer.bucketBy(buckets, "id").sortBy("id")
        writer.saveAsTable(fresh)
        written = {name: was + seen.get[name] for name, was in written.items()}
    if settings.generations:
        _switch(df.sparkSession, settings, layer, fresh)
    return written


def current_generation(spark: SparkSession, settings: Settings, layer: str) -> str | None:
    """The table a layer's view reads, or None before the first generation."""
    if not layer_exists(spark, settings, layer):
        return None
    comment = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {settings.table(layer)}").collect()}
    return comment.get(GENERATION_OF)


def _switch(spark: SparkSession, settings: Settings, layer: str, fresh: str) -> None:
    """Let the layer's view read ``fresh``; drop the generations that neither it nor the view before
    it reads."""
    table, old = settings.table(layer), current_generation(spark, settings, layer)
    if old is None and layer_exists(spark, settings, layer):
        raise ValueError(f"{table} is a plain table; drop it before it is kept in generations")
    spark.sql(f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('{GENERATION_OF}' = '{fresh}') AS SELECT * FROM {fresh}")
    prefix, keep = table.split(".")[-1] + GENERATION, {fresh, old}
    for found in spark.catalog.listTables(settings.namespace):
        name = f"{settings.namespace}.{found.name}"
        if found.name.startswith(prefix) and name not in keep:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_layer(spark: SparkSession, settings: Settings, layer: str) -> None:
    """Remove a layer that nothing reads any more, with all its generations."""
    table = settings.table(layer)
    kind = "TABLE" if current_generation(spark, settings, layer) is None else "VIEW"
    spark.sql(f"DROP {kind} IF EXISTS {table}")
    for found in spark.catalog.listTables(settings.namespace):
        if found.name.startswith(table.split(".")[-1] + GENERATION):
            spark.sql(f"DROP TABLE IF EXISTS {settings.namespace}.{found.name}")


@frees_shuffles
def replace_dates(
    df: DataFrame, settings: Settings, layer: str, dates: Sequence[date] | None, gathered: bool = False, rounds: int = 1,
) -> None:
    """Replace the partitions ``dates`` of a layer partitioned by ``post_date`` with the rows of ``df``;
    None replaces the whole layer, in ``rounds`` by id. A date that came back without rows is removed.

    Each partition is replaced as a whole, and a repeated call leaves the same table. A layer that
    was stored without such partitions is an error, not a silent rewrite. ``gathered`` says that ``df`` reads
    another layer of that kind row by row: its tasks hold few dates each and write them as they are.
    """
    spark, table = df.sparkSession, settings.table(layer)
    def spread(rows: DataFrame) -> DataFrame:
        # "rebalance" splits large dates over many files and merges small ones
        return rows if gathered else rows.hint("rebalance", F.col("post_date"))

    few_dates = partitions_open(spark) if gathered else nullcontext()
    if dates is None or not layer_exists(spark, settings, layer):
        with few_dates:
            for n, part in enumerate(in_rounds(df, rounds)):
                spread(part).write.mode("append" if n else "overwrite").options(**COMPACT).partitionBy("post_date").format(
                    "parquet").saveAsTable(table)
        return
    rows = spread(df)
    by = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if by != ["post_date"]:
        raise ValueError(f"{table} is not partitioned by post_date; rebuild it for all dates")
    seen = Observation(f"dates_{layer}")
    rows = rows.observe(seen, F.collect_set("post_date").alias("dates"))  # dates only
    with only_partitions_written(spark), few_dates:
        rows.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    written, held = set(seen.get["dates"]), {r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    for day in dates:
        if day not in written and f"post_date={day.isoformat()}" in held:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (post_date = DATE '{day.isoformat()}')")


def verify_write(
    spark: SparkSession, settings: Settings, layer: str, expected: int
) -> DataFrame:
    """(layer, expected, actual, ok): does the table hold the rows that were written?"""
    return read_layer(spark, settings, layer).agg(F.count(F.lit(1)).alias("actual")).select(
        F.lit(layer).alias("layer"), F.lit(expected).cast("bigint").alias("expected"), "actual",
        (F.col("actual") == expected).alias("ok"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Write a result as CSV with a header and no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)

"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import SparkSession

# Sizing that depends on the cluster (executors, memory, shuffle partitions) is left
# to spark-submit; with AQE on, a generous shuffle partition count is coalesced at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    app: str = "hearsay", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """Session with this package's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path that every executor can reach.

    It lies under the folder the cluster names in ``spark.checkpoint.dir``. Where that is
    unset a local session gets a temporary folder; any other session is refused, because a
    folder on one machine is lost with that machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="hearsay-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Has Spark remove the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
SHUFFLES_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; the setting is restored after. A frame that is run
    again computes its shuffles again."""
    before = spark.conf.get(SHUFFLES_FREED, None)
    spark.conf.set(SHUFFLES_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_FREED) if before is None else spark.conf.set(SHUFFLES_FREED, before)


#: Partitions that a writing task keeps open at a time; with 0 it sorts its rows by partition first.
OPEN_PARTITIONS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def partitions_open(spark: SparkSession, most: int = 16) -> Iterator[None]:
    """Tasks that hold few partitions write them side by side, without the sort whose texts go to disk. A task
    that meets more than ``most`` sorts the rest."""
    before = spark.conf.get(OPEN_PARTITIONS)
    spark.conf.set(OPEN_PARTITIONS, str(most))
    try:
        yield
    finally:
        spark.conf.set(OPEN_PARTITIONS, before)


def frees_shuffles(job: Callable) -> Callable:
    """A job of several queries, whose first argument is the session or a frame, run inside ``shuffles_freed``."""
    @wraps(job)
    def run(first, *args, **kwargs):
        with shuffles_freed(first if isinstance(first, SparkSession) else first.sparkSession):
            return job(first, *args, **kwargs)

    return run


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a path exist in whatever file system its scheme names?"""
    files, jvm_path = _file_system(spark, path)
    return files.exists(jvm_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this package wrote, if it is there."""
    files, jvm_path = _file_system(spark, path)
    files.delete(jvm_path, True)

"""Session settings and durable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

# What every plan of this library relies on. AQE splits skewed join partitions and
# coalesces small ones; height arithmetic needs UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "ledgerflow", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, read from ``spark.checkpoint.dir``; where that is unset,
    a folder under the session's warehouse, which all executors see as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


# Whether the shuffle files of a job go when the job ends, not once the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The writes inside leave no shuffle files: what they wrote is read from where it was written.

    A long job is many such writes, and without this the disk holds the shuffles of all.
    """
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def packed(df: DataFrame) -> DataFrameWriter:
    """A writer of intermediate files, which are read few times: small before fast."""
    return df.write.option("compression", "zstd")


# The folders that the innermost ``distilled`` deletes when it is done.
written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and keeps a lost executor from recomputing the past; unlike a
    row checkpoint the table stays columnar, so readers still prune columns and
    push filters, and its true size is known to the join planner. The shuffles that made it go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (scope := written.get()) is not None:
        scope.append(path)
    with shuffles_dropped(spark):
        packed(df).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def distilled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, stored; all else that it stored on the way is deleted."""
    token = written.set(inside := [])
    try:
        df = make()
    finally:
        written.reset(token)
    found = materialise(df, label)
    for path in inside:
        drop_path(df.sparkSession, path)
    return found

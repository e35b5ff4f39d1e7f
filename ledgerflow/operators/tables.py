"""Keyed upserts and retention of the stored tables.

Tables are plain Parquet, partitioned by ``height_bucket`` and sorted by height
inside a file, so height filters skip partitions and row groups.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.constants import BUCKET_BLOCKS, ENHANCED, SIX_MONTHS
from ledgerflow.operators.coverage import height_bucket
from ledgerflow.schemas import EVENT_KEY
from ledgerflow.session import drop_path, materialise, packed, shuffles_dropped

# Columns that attribution may have changed in a stored event.
ATTRIBUTED = (
    "from_type",
    "from_details",
    "to_type",
    "to_details",
    "classification_level",
    "intermediary_wallet",
    "hop_chain",
    "analysis_timestamp",
    "data_source",
)

CLEANUP_SLACK = 1.1
CLEANUP_INTERVAL = 1000


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last in ``order`` (given newest first).

    The rank limit is also applied before the shuffle, so a key with very many
    versions sends one row per task.
    """
    version = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_version", F.row_number().over(version)).filter("_version = 1").drop("_version")


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """``base`` with the rows of ``incoming`` put in by key; later ``seq`` wins.

    Incoming rows beat stored ones, so applying the same batch twice is the same as
    once.
    """
    rows = base.withColumn("_incoming", F.lit(0)).unionByName(incoming.withColumn("_incoming", F.lit(1)))
    order = [F.desc("_incoming"), *[F.desc(c) for c in seq]]
    return newest_per_key(rows, keys, order).drop("_incoming")


def upsert_events(base: DataFrame, incoming: DataFrame, reset: bool = False) -> DataFrame:
    """Upsert of flow events.

    A replaced event loses its attribution only with ``reset``; otherwise the
    columns of an attributed or analysed row survive.
    """
    merged = upsert(base, incoming, EVENT_KEY, ["event_seq"])
    if reset:
        return merged
    touched = (F.col("data_source") == ENHANCED) | F.col("analysis_timestamp").isNotNull()
    kept = newest_per_key(base.filter(touched), EVENT_KEY, [F.desc("event_seq")]).select(
        *EVENT_KEY, *[F.col(c).alias(f"_{c}") for c in ATTRIBUTED], F.lit(True).alias("_kept")
    )
    return merged.join(kept, EVENT_KEY, "left").select(
        *[
            F.when(F.col("_kept"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ATTRIBUTED else F.col(c)
            for c in merged.columns
        ]
    )


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None when nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_buckets(df: DataFrame, path: str, height: str, lookup: tuple[str, ...] = ("txid",)) -> None:
    """Replace the height buckets that ``df`` has rows in.

    Columns of ``lookup`` get bloom filters, so that a search for a key skips the row groups that
    do not hold it.

    The rebalance keeps a bucket together in few files, yet splits one that is too
    large for a task.
    """
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in lookup if c in df.columns}
    with shuffles_dropped(df.sparkSession):
        (
            packed(df.hint("rebalance", F.col("height_bucket")).sortWithinPartitions("height_bucket", height))
            .mode("overwrite")
            .options(**blooms, **{"parquet.bloom.filter.adaptive.enabled": "true"})
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("height_bucket")
            .parquet(path)
        )


def staged(df: DataFrame, path: str) -> None:
    """Write a frame that one batch needs for a while, in place of what an earlier try left."""
    with shuffles_dropped(df.sparkSession):
        packed(df).mode("overwrite").parquet(path)


def weeks(df: DataFrame) -> list[int]:
    """The height buckets of a frame, in order: one number per week of chain, 52 a year. The only
    rows of this library that come to the driver."""
    return sorted(r.height_bucket for r in df.select(F.col("height_bucket").cast("bigint")).distinct().collect())


def merge_into(
    path: str,
    incoming: DataFrame,
    merge,
    height: str,
    stage: str,
    keys: list[str],
    effects: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    effects_path: str | None = None,
    stored: bool = False,
) -> None:
    """Merge a batch into a stored table, rewriting only the buckets it touches.

    A key counts wherever it is stored: where it comes again at another height, its old
    bucket is rewritten as well. ``merge(base, incoming)`` gives the new rows. Batch and
    result are first written to ``stage``, a folder that belongs to one batch of one stream,
    published from there and removed: a run that dies in between finds the staged rows
    complete and publishes them again, never merging with half-replaced buckets; one that
    dies after it repeats the merge, which changes nothing. One process may write a table
    at a time.

    ``effects(old, new)`` says what the merge means to an aggregate of the table, given the
    stored rows of the batch's keys and the rows that replace them. It is staged with the rows
    and published once to ``effects_path``, a folder of this batch alone.

    A batch that its caller has ``stored`` already is read from there and not staged again.
    """
    spark = incoming.sparkSession
    if read_table(spark, f"{stage}/done") is None:
        incoming = incoming.withColumn("height_bucket", height_bucket(F.col(height)))
        if not stored:
            staged(incoming, f"{stage}/incoming")
            incoming = spark.read.schema(incoming.schema).parquet(f"{stage}/incoming")
        touched = incoming.select("height_bucket").distinct()
        base = read_table(spark, path)
        if base is None:
            base = incoming.limit(0)
        else:
            again = base.select(*keys, "height_bucket").join(incoming.select(*keys).distinct(), keys, "left_semi")
            touched = touched.unionByName(again.select(F.col("height_bucket").cast("bigint"))).distinct()
        staged(touched, f"{stage}/touched")
        # As literals the buckets prune the partitions read.
        base = base.filter(F.col("height_bucket").isin(weeks(spark.read.parquet(f"{stage}/touched")))).select(*incoming.columns)
        staged(merge(base, incoming), f"{stage}/rows")
        if effects is not None:
            of_batch = incoming.select(*keys).distinct()
            new = spark.read.parquet(f"{stage}/rows").join(of_batch, keys, "left_semi")
            staged(effects(base.join(of_batch, keys, "left_semi"), new), f"{stage}/effects")
        spark.range(1).write.mode("overwrite").parquet(f"{stage}/done")
        drop_path(spark, f"{stage}/incoming")
    rows = spark.read.parquet(f"{stage}/rows")
    write_buckets(rows, path, height)
    touched = spark.read.parquet(f"{stage}/touched")
    for week in weeks(touched.join(rows.select("height_bucket").distinct(), "height_bucket", "left_anti")):
        drop_path(spark, f"{path}/height_bucket={week}")  # all its rows moved away
    if effects is not None and read_table(spark, effects_path) is None:
        spark.read.parquet(f"{stage}/effects").write.parquet(effects_path)
    drop_path(spark, stage)


def cutoff(tip: Column, keep: int = SIX_MONTHS) -> Column:
    """Lowest height that retention keeps."""
    return F.greatest(tip - F.lit(keep), F.lit(1))


def retain(df: DataFrame, tip: Column, keep: int = SIX_MONTHS, height: str = "block_height") -> DataFrame:
    """Rows at or above the retention cutoff."""
    lowest = cutoff(tip, keep)
    kept = df.filter(F.col(height) >= lowest)
    if "height_bucket" in df.columns:
        kept = kept.filter(F.col("height_bucket") >= height_bucket(lowest))
    return kept


def retention_due(blocks: DataFrame, last_cleanup: int = 0, keep: int = SIX_MONTHS) -> DataFrame:
    """One row: height span, and whether it is time to clean up."""
    span = F.max("height") - F.min("height")
    due = (span > keep * CLEANUP_SLACK) & (F.max("height") - F.lit(last_cleanup) >= CLEANUP_INTERVAL)
    return blocks.agg(
        F.coalesce(span, F.lit(0)).alias("span"), F.coalesce(due, F.lit(False)).alias("due")
    )


def apply_retention(spark: SparkSession, tables: dict[str, tuple[str, str]], tip: int, keep: int = SIX_MONTHS) -> DataFrame:
    """Delete what lies below the cutoff from stored tables: whole partitions are dropped, only
    the week of the cutoff is rewritten.

    ``tables`` names each table's folder and height column. Returns per table the rows and weeks
    before, and how many were deleted. The boundary week is staged before it is replaced and
    every step deletes only what is below the cutoff, so a run that died is simply run again.
    """
    lowest = max(tip - keep, 1)
    report = []
    for name, (path, height) in tables.items():
        stored = read_table(spark, path)
        if stored is None:
            continue
        boundary = lowest // BUCKET_BLOCKS
        old = F.col(height) < lowest
        at_most = stored.filter(F.col("height_bucket") <= boundary)
        per_week = stored.groupBy(F.col("height_bucket").cast("bigint").alias("height_bucket")).agg(
            F.count("*").alias("n"), F.count_if(old).alias("n_old"), F.lit(name).alias("part")
        )
        counted = materialise(per_week, "retention")
        report.append(counted)
        rest = at_most.filter((F.col("height_bucket") == boundary) & ~old)
        gone = counted.filter("n_old = n")
        if not counted.filter("n_old > 0 AND n_old < n").isEmpty():
            write_buckets(materialise(rest, "boundary"), path, height)
        for week in weeks(gone):
            drop_path(spark, f"{path}/height_bucket={week}")
    return reduce(DataFrame.unionByName, report).groupBy("part").agg(
        F.sum("n").alias("rows_before"),
        F.sum("n_old").alias("rows_deleted"),
        F.count("*").alias("weeks_before"),
        F.count_if(F.col("n_old") == F.col("n")).alias("weeks_dropped"),
    )


def retention_report(
    blocks: DataFrame, txs: DataFrame, ev: DataFrame, tip: Column, keep: int = SIX_MONTHS
) -> DataFrame:
    """Rows per table that retention would delete."""
    lowest = cutoff(tip, keep)

    def old(df: DataFrame, name: str, height: str) -> DataFrame:
        return df.filter(F.col(height) < lowest).select(F.lit(name).alias("part"))

    rows = (
        old(blocks, "blocks", "height")
        .unionByName(old(txs, "transactions", "block_height"))
        .unionByName(old(ev, "flow_events", "block_height"))
    )
    return rows.agg(
        *[F.count_if(F.col("part") == n).alias(n) for n in ("blocks", "transactions", "flow_events")]
    )

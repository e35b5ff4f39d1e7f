"""How much of the chain is held: counts, spans, gaps, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.constants import BUCKET_BLOCKS, SIX_MONTH_DAYS, SIX_MONTHS
from ledgerflow.operators.periods import period_frame


def ledger_counts(blocks: DataFrame, txs: DataFrame, ev: DataFrame) -> DataFrame:
    """One row: blocks, transactions, events, newest height (0 if none)."""
    marks = (
        blocks.select(F.lit(1).alias("b"), F.lit(0).alias("t"), F.lit(0).alias("e"), "height")
        .unionByName(txs.select(F.lit(0).alias("b"), F.lit(1).alias("t"), F.lit(0).alias("e")), True)
        .unionByName(ev.select(F.lit(0).alias("b"), F.lit(0).alias("t"), F.lit(1).alias("e")), True)
    )
    return marks.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("blocks"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("transactions"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("flow_events"),
        F.coalesce(F.max("height"), F.lit(0)).alias("latest_height"),
    )


def coverage_stats(blocks: DataFrame) -> DataFrame:
    """Height range, span, age in days and percent of the six-month target."""
    span = F.col("max_height") - F.col("min_height")
    return blocks.agg(
        F.count("*").alias("blocks"),
        F.coalesce(F.min("height"), F.lit(0)).alias("min_height"),
        F.coalesce(F.max("height"), F.lit(0)).alias("max_height"),
    ).select(
        "blocks",
        "min_height",
        "max_height",
        span.alias("span"),
        F.round(span / F.lit(SIX_MONTHS) * SIX_MONTH_DAYS, 1).alias("age_days"),
        F.round(F.col("blocks") / F.lit(SIX_MONTHS) * 100, 1).alias("percent_of_target"),
    )


def period_readiness(blocks: DataFrame) -> DataFrame:
    """Per period: ready, partial, progress in percent; all false or 0 without blocks."""
    held = F.coalesce(blocks.agg(F.count("*")).scalar(), F.lit(0))
    frame = period_frame(blocks).withColumn("blocks_synced", held)
    any_block, complete = F.col("blocks_synced") > 0, F.col("blocks_synced") >= F.col("blocks")
    return frame.select(
        "period",
        (any_block & complete).alias("ready"),
        (any_block & ~complete).alias("partial"),
        F.round(F.col("blocks_synced") / F.col("blocks") * 100, 1).alias("progress"),
        F.col("blocks").alias("blocks_needed"),
        "blocks_synced",
        F.least(F.lit(100.0), F.col("blocks_synced") / F.lit(SIX_MONTHS) * 100).alias(
            "sync_progress"
        ),
    )


def height_bucket(height: Column, width: int = BUCKET_BLOCKS) -> Column:
    return F.floor(height / F.lit(width)).cast("bigint")


def block_gaps(blocks: DataFrame) -> DataFrame:
    """Missing height ranges between the first and the last block held.

    Gaps inside a bucket of heights need only that bucket; gaps across buckets need
    only one row per bucket, so no task sees more heights than a bucket has (the
    final window has one row per week of chain).
    """
    located = blocks.select("height").distinct().withColumn("bucket", height_bucket(F.col("height")))
    inside = located.select(
        "height", F.lead("height").over(Window.partitionBy("bucket").orderBy("height")).alias("next")
    )
    edges = located.groupBy("bucket").agg(F.min("height").alias("first"), F.max("height").alias("last"))
    across = edges.select(
        F.col("last").alias("height"), F.lead("first").over(Window.orderBy("bucket")).alias("next")
    )
    return (
        inside.unionByName(across)
        .filter(F.col("next") > F.col("height") + 1)
        .select(
            (F.col("height") + 1).alias("from_height"),
            (F.col("next") - 1).alias("to_height"),
            (F.col("next") - F.col("height") - 1).alias("missing"),
        )
    )

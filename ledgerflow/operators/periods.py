"""Trailing height frames. The block height is the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.constants import BUCKET_BLOCKS, PERIODS, period_blocks
from ledgerflow.schemas import Ledger


def tip(blocks: DataFrame) -> Column:
    """Newest height, from the blocks (not the events), as a scalar subquery.

    It runs once, before the main job, and its value then acts like a literal in
    filters, also in partition filters.
    """
    return blocks.agg(F.max("height")).scalar()


def in_period(height: Column, blocks: DataFrame, period: str) -> Column:
    """Whether a height lies in [tip - blocks(period), tip], both ends included."""
    newest = tip(blocks)
    return (newest > 0) & height.between(newest - F.lit(period_blocks(period)), newest)


def period_slice(ev: DataFrame, blocks: DataFrame, period: str) -> DataFrame:
    """Events of a trailing period; empty when there are no blocks.

    On a stored table the bounds also hold for its partitions, so a short period opens the
    files of its own weeks only.
    """
    found = ev.filter(in_period(F.col("block_height"), blocks, period))
    if "height_bucket" in ev.columns:
        newest, width = tip(blocks), F.lit(BUCKET_BLOCKS)
        lowest = F.floor((newest - F.lit(period_blocks(period))) / width)
        found = found.filter((F.col("height_bucket") >= lowest) & (F.col("height_bucket") <= F.floor(newest / width)))
    return found


def ledger_slice(led: Ledger, blocks: DataFrame, period: str) -> Ledger:
    """The ledger of a trailing period, to build only its events."""
    return led.filter(in_period(F.col("height"), blocks, period))


def period_frame(df: DataFrame) -> DataFrame:
    """The five periods as rows: position, period, blocks."""
    rows = [(i, name, n) for i, (name, n) in enumerate(PERIODS.items())]
    return df.sparkSession.createDataFrame(rows, "position INT, period STRING, blocks BIGINT")


def age_band(height: Column, blocks: DataFrame) -> Column:
    """Position of the shortest period that holds a height; null outside all.

    Aggregating by band and adding the bands up afterwards answers all periods in
    one pass, without repeating an event for each period it is in.
    """
    newest = tip(blocks)
    age = newest - height
    band = F.when((newest <= 0) | (age < 0), F.lit(None).cast("int"))
    for position, n in enumerate(PERIODS.values()):
        band = band.when(age <= n, F.lit(position))
    return band


def all_periods(banded: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Add up band aggregates into one row per period and key.

    ``banded`` holds few rows, one per band and key; each counts for its own period
    and all longer ones.
    """
    longest = len(PERIODS) - 1
    return (
        banded.withColumn("position", F.explode(F.sequence("band", F.lit(longest))))
        .groupBy("position", *keys)
        .agg(*[F.sum(c).alias(c) for c in sums])
        .join(period_frame(banded).select("position", "period"), "position")
    )

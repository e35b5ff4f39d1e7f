"""Answers over any range of heights out of stored partial aggregates.

Amounts and counts add up, so they are kept for every height and for blocks of 64, 4,096 and
262,144 heights. A range is the largest blocks that lie in it whole, and single heights at its two
edges: at most 126 blocks a level, however long the range and however many events it has.
Which rows these are is a filter on level and block, so the table is partitioned by level and
sorted by block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.constants import BUYING, SELLING
from ledgerflow.functions.scalars import coins
from ledgerflow.operators.summary import counterparty_type, exchange_name, zero_filled_types

ROLLUP_BITS = 6
ROLLUP_LEVELS = 4
CUBE = ["flow_type", "party_type", "exchange"]
PARTY = ["flow_type", "address", "exchange"]


def rolled_up(leaves: DataFrame, keys: list[str], merged: list[Column]) -> DataFrame:
    """``leaves`` (block, keys, values) with the coarser levels below; each is made of the one before."""
    levels = [leaves.withColumn("level", F.lit(0))]
    for level in range(1, ROLLUP_LEVELS):
        block = F.shiftright("block", ROLLUP_BITS).alias("block")
        levels.append(levels[-1].groupBy(block, *keys).agg(*merged).withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, levels)


def write_rollup(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", F.col("level")).sortWithinPartitions("level", "block").write.mode("overwrite").partitionBy("level").parquet(path)


def covering(lo: Column, hi: Column) -> Column:
    """Whether a row of a roll-up belongs to the cover of the heights [lo, hi]: its block lies in
    the range and its parent does not."""

    def inside(bits: Column, block: Column) -> Column:
        first = F.call_function("shiftleft", block, bits)
        last = F.call_function("shiftleft", block + 1, bits) - 1
        return (first >= lo) & (last <= hi)

    bits = F.col("level").cast("int") * ROLLUP_BITS
    own = inside(bits, F.col("block"))
    top = F.col("level") == ROLLUP_LEVELS - 1
    return own & (top | ~inside(bits + ROLLUP_BITS, F.shiftright("block", ROLLUP_BITS)))


def flow_rollup(ev: DataFrame) -> DataFrame:
    """Satoshi and events per flow type, counterparty type and exchange."""
    merged = [F.sum("satoshi").alias("satoshi"), F.sum("events").alias("events")]
    leaves = ev.groupBy(F.col("block_height").alias("block"), "flow_type", counterparty_type().alias("party_type"), exchange_name().alias("exchange")).agg(
        F.sum("satoshi").alias("satoshi"), F.count("*").alias("events")
    )
    return rolled_up(leaves, CUBE, merged)


def flow_summary_between(rollup: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Total and count per flow type in a range of heights, zero for a type without events."""
    found = rollup.filter(covering(lo, hi)).groupBy("flow_type").agg(F.sum("satoshi").alias("satoshi"), F.sum("events").alias("events"))
    return zero_filled_types(found)


def party_rollup(ev: DataFrame) -> DataFrame:
    """Satoshi, events, newest event and type then, per side, party and exchange."""
    side = F.when(F.col("flow_type") == BUYING, F.struct(F.col("to_address").alias("address"), F.col("to_type").alias("type")))
    side = side.when(F.col("flow_type") == SELLING, F.struct(F.col("from_address").alias("address"), F.col("from_type").alias("type")))
    newest = F.struct("block_height", "event_seq")
    leaves = (
        ev.filter(F.col("flow_type").isin(BUYING, SELLING))
        .withColumn("party", side)
        .groupBy(F.col("block_height").alias("block"), "flow_type", F.col("party.address").alias("address"), exchange_name().alias("exchange"))
        .agg(F.sum("satoshi").alias("satoshi"), F.count("*").alias("events"), F.max(newest).alias("newest"), F.max_by("party.type", newest).alias("type"))
    )
    merged = [F.sum("satoshi").alias("satoshi"), F.sum("events").alias("events"), F.max("newest").alias("newest"), F.max_by("type", "newest").alias("type")]
    return rolled_up(leaves, PARTY, merged)


def top_parties_between(rollup: DataFrame, side: str, lo: Column, hi: Column, n: int = 10) -> DataFrame:
    """The ``n`` addresses that bought or sold most in a range of heights; ties by newest event."""
    if n <= 0:
        raise ValueError("n must be positive")
    total = "total_bought" if side == BUYING else "total_sold"
    return (
        rollup.filter(covering(lo, hi) & (F.col("flow_type") == side))
        .groupBy("address")
        .agg(
            F.max_by("type", "newest").alias("type"),
            F.sum("satoshi").alias("satoshi"),
            F.sum("events").alias("event_count"),
            F.array_sort(F.collect_set("exchange")).alias("exchanges"),
            F.max("newest").alias("newest"),
        )
        .orderBy(F.desc("satoshi"), F.desc("newest"), "address")
        .limit(n)
        .select("address", "type", coins(F.col("satoshi")).alias(total), "event_count", "exchanges")
    )

"""Range scans and point lookups on the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.constants import BUCKET_BLOCKS


def heights_between(df: DataFrame, lo: int, hi: int, height: str = "block_height") -> DataFrame:
    """Rows of an inclusive height range; whole partitions outside it are not read."""
    found = df.filter(F.col(height).between(lo, hi))
    if "height_bucket" in df.columns:
        found = found.filter(F.col("height_bucket").between(lo // BUCKET_BLOCKS, hi // BUCKET_BLOCKS))
    return found


def flow_events_between(ev: DataFrame, lo: int, hi: int, ordered: bool = False) -> DataFrame:
    """Events of a height range; ``ordered`` sorts newest first, for display."""
    found = heights_between(ev, lo, hi)
    return newest_first(found) if ordered else found


def newest_first(ev: DataFrame) -> DataFrame:
    return ev.orderBy(F.desc("block_height"), F.desc("event_seq"))


def lookup(df: DataFrame, **key) -> DataFrame:
    """Rows whose key columns equal the given values."""
    if not key:
        raise ValueError("name at least one key column")
    for name, value in key.items():
        df = df.filter(F.col(name) == value)
        if name in ("height", "block_height") and "height_bucket" in df.columns:
            df = df.filter(F.col("height_bucket") == value // BUCKET_BLOCKS)
    return df


def tx_between(tx: DataFrame, lo: int, hi: int) -> DataFrame:
    """Transactions of a height range, newest first."""
    return heights_between(tx, lo, hi).orderBy(F.desc("block_height"), F.desc("tx_index"))


def tx_in_block(tx: DataFrame, height: int) -> DataFrame:
    return lookup(tx, block_height=height)


def tx_by_flow_type(tx: DataFrame, flow_type: str, n: int | None = None) -> DataFrame:
    """The transactions of a flow type, newest first; the newest ``n`` where asked for."""
    found = tx.filter(F.col("flow_type") == flow_type).orderBy(F.desc("block_time"), F.desc("tx_index"))
    return found if n is None else found.limit(positive(n))


def positive(n: int) -> int:
    """A row limit; anything below one is an error."""
    if n < 1:
        raise ValueError(f"a limit must be at least 1, not {n}")
    return n


def latest_block(blocks: DataFrame) -> DataFrame:
    """The block with the greatest height, as one row."""
    return blocks.orderBy(F.desc("height")).limit(1)

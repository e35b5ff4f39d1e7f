"""Answers over the flow events of a period.

The period questions all roll up one small aggregate, ``flow_cube``: event sums and
counts per flow type, counterparty type and exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.constants import BUYING, COUNTERPARTY_TYPES, P2P, PERIODS, SELLING
from ledgerflow.functions.scalars import coins
from ledgerflow.operators.periods import age_band, all_periods, period_frame

FLOW_TYPES = (BUYING, SELLING, P2P)

# Chart categories of the two sides.
CATEGORIES = [
    (BUYING, "node_operator", "toNodeOperators", "To Node Operators"),
    (BUYING, "unknown", "toUnknown", "To Unknown Wallets"),
    (BUYING, "foundation", "toFoundation", "To Foundation"),
    (SELLING, "node_operator", "fromNodeOperators", "From Node Operators"),
    (SELLING, "unknown", "fromUnknown", "From Unknown Wallets"),
    (SELLING, "foundation", "fromFoundation", "From Foundation"),
]


def _is(side: str) -> Column:
    return F.col("flow_type") == side


def counterparty_type() -> Column:
    """Type of the party that is not the exchange; null for p2p."""
    return F.when(_is(BUYING), F.col("to_type")).when(_is(SELLING), F.col("from_type"))


def exchange_name() -> Column:
    """Name of the exchange side; null for p2p or a nameless exchange."""
    name = F.when(_is(BUYING), F.col("from_details.name")).when(_is(SELLING), F.col("to_details.name"))
    return F.nullif(name, F.lit(""))


def flow_cube(ev: DataFrame, *extra: Column) -> DataFrame:
    """One pass over the events: satoshi and events per type, counterparty, exchange."""
    return ev.groupBy(
        "flow_type",
        counterparty_type().alias("party_type"),
        exchange_name().alias("exchange"),
        *extra,
    ).agg(F.sum("satoshi").alias("satoshi"), F.count("*").alias("events"))


def _zero_filled(frame: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return frame.join(found, keys, "left").withColumns(
        {
            "satoshi": F.coalesce("satoshi", F.lit(0)),
            "events": F.coalesce("events", F.lit(0)).cast("bigint"),
        }
    )


def _flow_type_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(t,) for t in FLOW_TYPES], "flow_type STRING")


def _rolled(cube: DataFrame, *keys: str) -> DataFrame:
    return cube.groupBy(*keys).agg(F.sum("satoshi").alias("satoshi"), F.sum("events").alias("events"))


def flow_summary(ev: DataFrame) -> DataFrame:
    """Total and count per flow type, zero for a type without events."""
    return zero_filled_types(_rolled(flow_cube(ev), "flow_type"))


def zero_filled_types(found: DataFrame) -> DataFrame:
    """A row per flow type out of (flow_type, satoshi, events), zero where there is none."""
    return _zero_filled(_flow_type_frame(found), found, ["flow_type"]).select(
        "flow_type", coins(F.col("satoshi")).alias("total"), "events"
    )


def flow_breakdown(ev: DataFrame) -> DataFrame:
    """Both sides by counterparty type (operator, unknown, foundation), zero-filled."""
    rows = [(side, kind) for side in (BUYING, SELLING) for kind in COUNTERPARTY_TYPES]
    frame = ev.sparkSession.createDataFrame(rows, "flow_type STRING, party_type STRING")
    found = _rolled(flow_cube(ev), "flow_type", "party_type")
    return _zero_filled(frame, found, ["flow_type", "party_type"]).select(
        "flow_type", "party_type", coins(F.col("satoshi")).alias("total"), "events"
    )


def by_exchange(ev: DataFrame) -> DataFrame:
    """Totals and counts per side and named exchange."""
    cube = flow_cube(ev.filter(F.col("flow_type").isin(BUYING, SELLING)))
    return _rolled(cube.filter(F.col("exchange").isNotNull()), "flow_type", "exchange").select(
        "flow_type", "exchange", coins(F.col("satoshi")).alias("total"), "events"
    )


def _sides(cube: DataFrame, *keys: str) -> DataFrame:
    def total(side: str) -> Column:
        return coins(F.coalesce(F.sum(F.when(_is(side), F.col("satoshi"))), F.lit(0))).alias(side)

    return cube.groupBy(*keys).agg(total(BUYING), total(SELLING), total(P2P))


def net_flow(ev: DataFrame) -> DataFrame:
    """One row: buying, selling, their difference."""
    return _sides(flow_cube(ev)).select(
        BUYING, SELLING, (F.col(BUYING) - F.col(SELLING)).alias("net_flow")
    )


def _all_period_sides(ev: DataFrame, blocks: DataFrame) -> DataFrame:
    cube = flow_cube(ev, age_band(F.col("block_height"), blocks).alias("band"))
    added = all_periods(cube.filter("band is not null"), ["flow_type"], ["satoshi", "events"])
    return period_frame(ev).select("position", "period").join(_sides(added, "period"), "period", "left").select(
        "position",
        "period",
        *[F.coalesce(side, F.lit(0.0)).alias(side) for side in FLOW_TYPES],
    )


def net_flow_all_periods(ev: DataFrame, blocks: DataFrame) -> DataFrame:
    """Buying, selling, p2p and net flow of all five periods in one pass."""
    return _all_period_sides(ev, blocks).select(
        "period", BUYING, SELLING, P2P, (F.col(BUYING) - F.col(SELLING)).alias("net_flow")
    )


def sentiment_columns() -> list[Column]:
    """Bullish only if buying exceeds selling; a tie is Bearish."""
    return [
        F.when(F.col(BUYING) > F.col(SELLING), "Bullish").otherwise("Bearish").alias("sentiment"),
        F.abs(F.col(BUYING) - F.col(SELLING)).alias("difference"),
    ]


def sentiment(ev: DataFrame) -> DataFrame:
    return _sides(flow_cube(ev)).select(BUYING, SELLING, *sentiment_columns())


def sentiment_all_periods(ev: DataFrame, blocks: DataFrame) -> DataFrame:
    return _all_period_sides(ev, blocks).select("period", BUYING, SELLING, *sentiment_columns())


def event_range(ev: DataFrame) -> DataFrame:
    """Newest and oldest height with an event and the number of events; zeros if none."""
    return ev.agg(
        F.coalesce(F.max("block_height"), F.lit(0)).alias("newest"),
        F.coalesce(F.min("block_height"), F.lit(0)).alias("oldest"),
        F.count("*").alias("events"),
    )


def _top_parties(ev: DataFrame, side: str, n: int, total: str) -> DataFrame:
    if n <= 0:
        raise ValueError("n must be positive")
    prefix = "to" if side == BUYING else "from"
    newest = F.struct("block_height", "event_seq")
    per_exchange = (
        ev.filter(_is(side))
        .groupBy(F.col(f"{prefix}_address").alias("address"), exchange_name().alias("exchange"))
        .agg(
            F.sum("satoshi").alias("satoshi"),
            F.count("*").alias("events"),
            F.max(newest).alias("newest"),
            F.max_by(f"{prefix}_type", newest).alias("type"),
        )
    )
    return (
        per_exchange.groupBy("address")
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


def top_buyers(ev: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` addresses that bought most; ties by newest event.

    Events are combined per (address, exchange) before they meet per address, so the
    set of exchange names is the largest thing a group ever holds.
    """
    return _top_parties(ev, BUYING, n, "total_bought")


def top_sellers(ev: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` addresses that sold most; ties by newest event."""
    return _top_parties(ev, SELLING, n, "total_sold")


def category_series(ev: DataFrame) -> DataFrame:
    """Per side and category: value, events, percent of the side, height of the bar.

    The bar of a side is its total relative to the larger of the two sides.
    """
    frame = ev.sparkSession.createDataFrame(
        CATEGORIES, "flow_type STRING, party_type STRING, category STRING, label STRING"
    )
    cube = flow_cube(ev.filter(F.col("flow_type").isin(BUYING, SELLING)))
    per_side = cube.groupBy("flow_type", "party_type").agg(
        F.sum("satoshi").alias("satoshi"), F.sum("events").alias("events")
    )
    # Side totals ride along as one more grouping of the same few rows.
    totals = per_side.groupBy("flow_type").agg(F.sum("satoshi").alias("side_satoshi"))
    largest = totals.agg(F.max("side_satoshi")).scalar()
    value, side = coins(F.col("satoshi")), coins(F.coalesce("side_satoshi", F.lit(0)))
    percent = F.coalesce(F.try_divide(value, side) * 100, F.lit(0.0))
    bar = F.coalesce(F.try_divide(side, coins(largest)) * 100, F.lit(0.0))
    return (
        _zero_filled(frame, per_side, ["flow_type", "party_type"])
        .join(totals, "flow_type", "left")
        .select(
            "flow_type",
            "category",
            "label",
            value.alias("value"),
            "events",
            percent.alias("percentage"),
            bar.alias("bar_height"),
        )
    )


def drill_down(ev: DataFrame, side: str, party_type: str) -> DataFrame:
    """Events of one side whose counterparty has the given type."""
    return ev.filter(_is(side) & (counterparty_type() == party_type))


def flow_type_stats(ev: DataFrame) -> DataFrame:
    """All-time events and amount per flow type."""
    return ev.groupBy("flow_type").agg(
        F.count("*").alias("events"), coins(F.sum("satoshi")).alias("total_amount")
    )

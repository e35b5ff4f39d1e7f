"""The transaction-level view: flow direction and parties per whole transaction.

Parties are kept in long form, one row per (transaction, direction, position), so no
row grows with a transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.constants import EXCHANGE
from ledgerflow.functions.scalars import coins
from ledgerflow.operators.labels import classify_addresses
from ledgerflow.operators.scans import positive
from ledgerflow.schemas import Ledger

# Flow types of this view with their direction.
BUY, SELL, MOVE = "buy", "sell", "transfer"
DIRECTIONS = {SELL: "to_exchange", BUY: "from_exchange", MOVE: "exchange_to_exchange"}


def explode_classifications(led: Ledger, labels: DataFrame) -> DataFrame:
    """Every party of every transaction: first the senders, then the receivers."""

    def side(frame: DataFrame, position: str, direction: str) -> DataFrame:
        return frame.filter(F.col("address").isNotNull()).select(
            "txid",
            F.lit(direction).alias("direction"),
            F.col(position).alias("pos"),
            "addr_pos",
            "address",
        )

    parties = side(led.inputs, "pos", "from").unionByName(side(led.outputs, "vout", "to"))
    return classify_addresses(parties, "address", labels)


def classify_transactions(led: Ledger, labels: DataFrame) -> DataFrame:
    """Transactions with flow type, direction and total output value.

    Any exchange among the senders or receivers decides. Header and party rows meet
    in one partial and final aggregation per transaction; the exchange lookup keeps
    only rows of exchanges. The header is part of the grouping, so a range of heights
    is cut before the shuffle.
    """
    header = ["txid", "height", "block_time", "tx_index"]
    exchanges = labels.filter(F.col("type") == EXCHANGE).select("address")
    rows = (
        led.txs.select(*header)
        .unionByName(
            led.outputs.filter("addr_pos = 0").select(*header, "satoshi"), allowMissingColumns=True
        )
        .unionByName(
            led.inputs.join(exchanges, "address", "left_semi").select(*header, F.lit(True).alias("ex_from")),
            allowMissingColumns=True,
        )
        .unionByName(
            led.outputs.join(exchanges, "address", "left_semi").select(*header, F.lit(True).alias("ex_to")),
            allowMissingColumns=True,
        )
    )
    per_tx = rows.groupBy("txid", F.col("height").alias("block_height"), "block_time", "tx_index").agg(
        F.coalesce(F.sum("satoshi"), F.lit(0)).alias("satoshi"),
        F.coalesce(F.bool_or("ex_from"), F.lit(False)).alias("ex_from"),
        F.coalesce(F.bool_or("ex_to"), F.lit(False)).alias("ex_to"),
    )
    kind = (
        F.when(F.col("ex_to") & ~F.col("ex_from"), SELL)
        .when(F.col("ex_from") & ~F.col("ex_to"), BUY)
        .when(F.col("ex_from") & F.col("ex_to"), MOVE)
    )
    direction = F.when(kind == SELL, DIRECTIONS[SELL]).when(kind == BUY, DIRECTIONS[BUY]).when(
        kind == MOVE, DIRECTIONS[MOVE]
    )
    return per_tx.filter(F.col("block_height").isNotNull()).select(
        "txid",
        "block_height",
        "block_time",
        "tx_index",
        "satoshi",
        coins(F.col("satoshi")).alias("total_value"),
        kind.alias("flow_type"),
        direction.alias("flow_direction"),
    )


def _in_range(lo: int | None, hi: int | None) -> Column:
    condition = F.lit(True)
    if lo is not None:
        condition = condition & (F.col("block_height") >= lo)
    if hi is not None:
        condition = condition & (F.col("block_height") <= hi)
    return condition


def flows_between(tx: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """Transactions with a flow type in a height range."""
    return tx.filter(_in_range(lo, hi) & F.col("flow_type").isNotNull())


def tx_with_parties(tx: DataFrame, parties: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Flow transactions of a range with all their parties, one row per party."""
    return flows_between(tx, lo, hi).join(parties, "txid", "left")


def _newest(tx: DataFrame, kind: str, lo: int | None, hi: int | None, n: int | None) -> DataFrame:
    found = flows_between(tx, lo, hi).filter(F.col("flow_type") == kind)
    found = found.orderBy(F.desc("block_height"), F.desc("tx_index"))
    return found if n is None else found.limit(positive(n))


def buying_transactions(tx: DataFrame, lo: int | None = None, hi: int | None = None, n: int | None = None) -> DataFrame:
    """Transactions that come from an exchange, newest first; the newest ``n`` where asked for."""
    return _newest(tx, BUY, lo, hi, n)


def selling_transactions(tx: DataFrame, lo: int | None = None, hi: int | None = None, n: int | None = None) -> DataFrame:
    """Transactions that go to an exchange, newest first; the newest ``n`` where asked for."""
    return _newest(tx, SELL, lo, hi, n)


def tx_flow_summary(tx: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Count and value per flow type in a range; zero rows for types without any."""
    frame = tx.sparkSession.createDataFrame([(k,) for k in (BUY, SELL, MOVE)], "flow_type STRING")
    found = flows_between(tx, lo, hi).groupBy("flow_type").agg(
        F.count("*").alias("tx_count"), F.sum("satoshi").alias("satoshi")
    )
    return frame.join(found, "flow_type", "left").select(
        "flow_type",
        F.coalesce("tx_count", F.lit(0)).cast("bigint").alias("tx_count"),
        coins(F.coalesce("satoshi", F.lit(0))).alias("total_value"),
    )


def _top(tx, parties, kind: str, direction: str, lo, hi, n: int, total: str) -> DataFrame:
    if n <= 0:
        raise ValueError("n must be positive")
    rows = parties.filter((F.col("direction") == direction) & (F.col("type") != EXCHANGE)).select(
        "txid", "address", "type"
    )
    # The value of a transaction counts once per party row, so an address paid twice
    # by one transaction counts it twice. Rows of one transaction combine first.
    per_tx = (
        flows_between(tx, lo, hi)
        .filter(F.col("flow_type") == kind)
        .select("txid", "satoshi")
        .join(rows, "txid")
        .groupBy("address", "txid")
        .agg(F.min("type").alias("type"), F.sum("satoshi").alias("satoshi"))
    )
    return (
        per_tx.groupBy("address")
        .agg(
            F.min("type").alias("type"),
            F.count("*").alias("transaction_count"),
            F.sum("satoshi").alias("satoshi"),
        )
        .orderBy(F.desc("satoshi"), "address")
        .limit(n)
        .select("address", "type", "transaction_count", coins(F.col("satoshi")).alias(total))
    )


def tx_top_buyers(tx, parties, lo=None, hi=None, n: int = 10) -> DataFrame:
    """Addresses that received most in buy transactions, exchanges left out."""
    return _top(tx, parties, BUY, "to", lo, hi, n, "total_bought")


def tx_top_sellers(tx, parties, lo=None, hi=None, n: int = 10) -> DataFrame:
    """Addresses that sent most in sell transactions, exchanges left out."""
    return _top(tx, parties, SELL, "from", lo, hi, n, "total_sold")


def exchange_activity(tx: DataFrame, parties: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """In- and outflow and number of transactions per exchange address."""
    exchanges = parties.filter(F.col("type") == EXCHANGE).select(
        "txid", "direction", "address", F.col("details.name").alias("name")
    )
    to, out = F.col("direction") == "to", F.col("direction") == "from"

    def amount(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("satoshi")).otherwise(F.lit(0)))

    per_tx = (
        flows_between(tx, lo, hi)
        .filter(F.col("flow_type").isin(BUY, SELL))
        .select("txid", "flow_type", "satoshi")
        .join(exchanges, "txid")
        .groupBy("address", "txid")
        .agg(
            F.max("name").alias("name"),
            amount(to & (F.col("flow_type") == SELL)).alias("inflow"),
            amount(out & (F.col("flow_type") == BUY)).alias("outflow"),
            F.max(F.when(to, 1).otherwise(0)).alias("sells"),
            F.max(F.when(out, 1).otherwise(0)).alias("buys"),
        )
    )
    return (
        per_tx.groupBy("address")
        .agg(
            F.max("name").alias("exchange_name"),
            F.sum("inflow").alias("inflow"),
            F.sum("outflow").alias("outflow"),
            F.sum("sells").alias("sell_transactions"),
            F.sum("buys").alias("buy_transactions"),
        )
        .select(
            F.col("address").alias("exchange_address"),
            "exchange_name",
            coins(F.col("inflow")).alias("total_inflow"),
            coins(F.col("outflow")).alias("total_outflow"),
            "sell_transactions",
            "buy_transactions",
        )
    )


def by_activity(activity: DataFrame) -> DataFrame:
    """Busiest exchange address first, for display."""
    return activity.orderBy(F.desc(F.col("total_inflow") + F.col("total_outflow")), "exchange_address")


def classification_counts(parties: DataFrame) -> DataFrame:
    """Party rows per classification type."""
    return parties.groupBy(F.col("type").alias("classification_type")).agg(F.count("*").alias("parties"))


def tx_view_stats(blocks: DataFrame, tx: DataFrame, parties: DataFrame) -> DataFrame:
    """One row: blocks and their range, transactions, classifications, totals per flow."""
    rows = (
        blocks.select(F.lit("block").alias("part"), "height")
        .unionByName(
            tx.select(F.lit("tx").alias("part"), "flow_type", "satoshi"), allowMissingColumns=True
        )
        .unionByName(parties.select(F.lit("party").alias("part")), allowMissingColumns=True)
    )

    def flow(kind: str) -> list[Column]:
        mine = F.col("flow_type") == kind
        return [
            F.count_if(mine).alias(f"{kind}_count"),
            coins(F.coalesce(F.sum(F.when(mine, F.col("satoshi"))), F.lit(0))).alias(f"{kind}_value"),
        ]

    return rows.agg(
        F.count_if(F.col("part") == "block").alias("blocks"),
        F.min("height").alias("min_height"),
        F.max("height").alias("max_height"),
        F.count_if(F.col("part") == "tx").alias("transactions"),
        F.count_if(F.col("part") == "party").alias("classifications"),
        *flow(BUY),
        *flow(SELL),
        *flow(MOVE),
    )

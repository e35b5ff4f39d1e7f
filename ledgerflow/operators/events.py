"""From ledger rows to flow events: one event per transaction output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.constants import (
    BUYING,
    EXCHANGE,
    FOUNDATION,
    NODE_OPERATOR,
    P2P,
    SELLING,
    SYNC,
    TRANSFER,
    UNKNOWN,
)
from ledgerflow.functions.scalars import MONEY, coins
from ledgerflow.operators.labels import classify_addresses
from ledgerflow.operators.scans import positive
from ledgerflow.schemas import Ledger

# Outputs of one transaction are numbered below this; block size keeps them far lower.
VOUT_RANGE = 1 << 20


def transfers_only(led: Ledger) -> Ledger:
    """Drop coinbase and confirmation transactions; sources without kinds keep all."""
    return led.filter(F.col("kind").isNull() | (F.col("kind") == TRANSFER))


def cap_per_block(led: Ledger, n: int | None = None) -> Ledger:
    """Keep the first ``n`` transfers of every block; off by default, as it loses data.

    The rank filter is evaluated before and after the shuffle, so a crowded block
    sends at most ``n`` rows per task.
    """
    transfers = transfers_only(led)
    if n is None:
        return transfers
    positive(n)
    position = Window.partitionBy("height").orderBy("tx_index", "txid")
    txs = (
        transfers.txs.withColumn("_rank", F.row_number().over(position))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )
    kept = txs.select("txid")
    return Ledger(
        txs,
        transfers.inputs.join(kept, "txid", "left_semi"),
        transfers.outputs.join(kept, "txid", "left_semi"),
    )


def flow_type(from_type: str = "from_type", to_type: str = "to_type") -> Column:
    """Selling goes to an exchange, buying comes from one, all else is p2p."""
    return F.expr(
        f"""CASE WHEN {to_type} = '{EXCHANGE}' AND {from_type} <> '{EXCHANGE}' THEN '{SELLING}'
                 WHEN {from_type} = '{EXCHANGE}' AND {to_type} <> '{EXCHANGE}' THEN '{BUYING}'
                 ELSE '{P2P}' END"""
    )


def event_seq() -> Column:
    """Order of events inside a block."""
    return F.expr(f"CAST(tx_index AS BIGINT) * {VOUT_RANGE}L + vout")


# Among inputs an operator beats the foundation, unlike in the label lookup.
_INPUT_RANK = f"""CASE type WHEN '{EXCHANGE}' THEN 0 WHEN '{NODE_OPERATOR}' THEN 1
                            WHEN '{FOUNDATION}' THEN 2 ELSE 3 END"""


def senders(led: Ledger, labels: DataFrame) -> DataFrame:
    """One row per relevant transaction with its primary input.

    Relevant: the first address of some input or output has a label. The primary
    input looks at *all* input addresses in order. Both are decided by one partial
    and one final aggregation per transaction over input rows and labelled output
    rows, so a large transaction never meets in one task before it is combined.
    """
    labelled_inputs = classify_addresses(
        led.inputs.select("txid", "pos", "addr_pos", "address"), "address", labels
    )
    evidence = labelled_inputs.selectExpr(
        "txid",
        f"type <> '{UNKNOWN}' AND addr_pos = 0 AS relevant",
        f"if(address IS NULL, NULL, struct({_INPUT_RANK} AS rank, pos, addr_pos)) AS at",
        "struct(address, type, details) AS party",
    ).unionByName(
        led.outputs.filter("addr_pos = 0")
        .join(labels.select("address"), "address", "left_semi")
        .selectExpr("txid", "true AS relevant"),
        allowMissingColumns=True,
    )
    return (
        evidence.groupBy("txid")
        .agg(F.expr("bool_or(relevant) AS relevant"), F.expr("min_by(party, at) AS party"))
        .filter("relevant")
        .selectExpr(
            "txid",
            f"coalesce(party.address, '{UNKNOWN}') AS from_address",
            f"coalesce(party.type, '{UNKNOWN}') AS from_type",
            "party.details AS from_details",
        )
    )


def relevant_only(led: Ledger, labels: DataFrame, found: DataFrame | None = None) -> Ledger:
    """The transactions that touch a labelled address; ``found`` are their senders, where a job
    has them already."""
    keep = (senders(led, labels) if found is None else found).select("txid")
    return Ledger(
        led.txs.join(keep, "txid", "left_semi"),
        led.inputs.join(keep, "txid", "left_semi"),
        led.outputs.join(keep, "txid", "left_semi"),
    )


def primary_input(led: Ledger, labels: DataFrame) -> DataFrame:
    """txid, from_address, from_type, from_details of the relevant transactions."""
    return senders(led, labels)


def explode_outputs(led: Ledger) -> DataFrame:
    """One row per output that has an address; the receiver is its first address."""
    return led.outputs.filter((F.col("addr_pos") == 0) & F.col("address").isNotNull())


def build_flow_events(led: Ledger, labels: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """All flow events of a ledger; ``found`` are the senders of its transfers, where a job has
    them already.

    The outputs meet their sender first, on txid, where a chain or the numbering has put them,
    so only those of relevant transactions are shuffled, once, to look their receiver up. Slice
    the ledger first (``periods.ledger_slice``) to build the events of a period only.
    """
    transfers = transfers_only(led)
    found = senders(transfers, labels) if found is None else found
    sent = explode_outputs(transfers).withColumnRenamed("address", "to_address").join(found, "txid")
    return classify_addresses(sent, "to_address", labels, "to_").select(
        "txid",
        "vout",
        F.col("height").alias("block_height"),
        "block_time",
        event_seq().alias("event_seq"),
        *["from_address", "from_type", "from_details", "to_address", "to_type", "to_details"],
        flow_type().alias("flow_type"),
        F.col("satoshi").cast(MONEY).alias("satoshi"),
        coins(F.col("satoshi")).alias("amount"),
        *[F.expr(default) for default in UNATTRIBUTED],
    )


# The attribution columns at their defaults.
UNATTRIBUTED = (
    "0 AS classification_level",
    "CAST(NULL AS STRING) AS intermediary_wallet",
    "CAST(NULL AS ARRAY<STRING>) AS hop_chain",
    "CAST(NULL AS BIGINT) AS analysis_timestamp",
    f"'{SYNC}' AS data_source",
)


def tx_totals(led: Ledger) -> DataFrame:
    """Per transaction: number and total of its inputs and outputs, zero if none."""

    def side(frame: DataFrame, i: int, o: int) -> DataFrame:
        return frame.filter("addr_pos = 0").selectExpr(
            "txid", "height", "block_time", f"{i} AS i", f"{o} AS o", f"coalesce(satoshi, CAST(0 AS {MONEY})) AS satoshi"
        )

    header = led.txs.selectExpr("txid", "height", "block_time", "0 AS i", "0 AS o", f"CAST(0 AS {MONEY}) AS satoshi")
    rows = header.unionByName(side(led.inputs, 1, 0), True).unionByName(side(led.outputs, 0, 1), True)
    # Grouped by height as well, so that a range of heights is cut before the shuffle.
    return rows.groupBy("txid", F.col("height").alias("block_height"), "block_time").agg(
        F.expr("sum(i) AS input_count"),
        F.expr("sum(o) AS output_count"),
        coins(F.expr("coalesce(sum(if(i = 1, satoshi, NULL)), 0)")).alias("total_input_value"),
        coins(F.expr("coalesce(sum(if(o = 1, satoshi, NULL)), 0)")).alias("total_output_value"),
    )


def relevance_counts(led: Ledger, with_event: DataFrame) -> DataFrame:
    """Per block: transactions seen, and those of ``with_event`` (height, txid)."""
    once = with_event.groupBy("height", "txid").agg(F.lit(1).alias("relevant"))
    return (
        led.txs.select("height", F.lit(1).alias("seen"), F.lit(0).alias("relevant"))
        .unionByName(once.select("height", F.lit(0).alias("seen"), "relevant"))
        .groupBy("height")
        .agg(F.sum("relevant").alias("relevant"), F.sum("seen").alias("seen"))
    )


def own_count() -> Column:
    """A block's own count of transactions; null where it gives none or zero."""
    return F.nullif(F.col("tx_count"), F.lit(0)).cast("bigint")


def share(counts: DataFrame) -> DataFrame:
    """Add ``rate``, relevant by total; 0 where there is no transaction."""
    rate = F.when(F.col("total") > 0, F.col("relevant") / F.col("total")).otherwise(F.lit(0.0))
    return counts.withColumn("rate", rate)


def rated(counts: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Counts per block as relevant, total and rate.

    The total is the block's own count, else the transactions seen. Blocks of which no
    transaction was seen have a row as well.
    """
    if blocks is None:
        return share(counts.select("height", "relevant", F.col("seen").alias("total")))
    own = blocks.select("height", F.lit(0).alias("relevant"), F.lit(0).alias("seen"), own_count().alias("own"))
    both = counts.unionByName(own, allowMissingColumns=True).groupBy("height").agg(
        F.sum("relevant").alias("relevant"), F.coalesce(F.max("own"), F.sum("seen")).alias("total")
    )
    return share(both)


def relevance_rate(led: Ledger, labels: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Per block: transactions, those that yield an event, and their share.

    A block counts as ``blocks`` says, where given, else by the transactions of the ledger.
    """
    transfers = transfers_only(led)
    with_event = explode_outputs(transfers).join(senders(transfers, labels).select("txid"), "txid", "left_semi")
    return rated(relevance_counts(led, with_event.select("height", "txid")), blocks)

"""Types of the raw payloads and of the stored tables, as DDL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Raw transaction: the union of the two dialects the sources send. Amounts are read
# as text because both numbers and texts occur.
RAW_TX = """
    txid STRING,
    vin ARRAY<STRUCT<addresses: ARRAY<STRING>, value: STRING>>,
    vout ARRAY<STRUCT<addresses: ARRAY<STRING>,
                      scriptPubKey: STRUCT<addresses: ARRAY<STRING>>,
                      value: STRING, n: INT>>,
    inputs ARRAY<STRUCT<address: STRING, addresses: ARRAY<STRING>,
                        value: STRING, valueSat: STRING>>,
    outputs ARRAY<STRUCT<address: STRING, addresses: ARRAY<STRING>,
                         value: STRING, valueSat: STRING, n: INT>>
"""
_RAW_TX_FIELDS = """
    txid: STRING,
    vin: ARRAY<STRUCT<addresses: ARRAY<STRING>, value: STRING>>,
    vout: ARRAY<STRUCT<addresses: ARRAY<STRING>,
                       scriptPubKey: STRUCT<addresses: ARRAY<STRING>>,
                       value: STRING, n: INT>>,
    inputs: ARRAY<STRUCT<address: STRING, addresses: ARRAY<STRING>,
                         value: STRING, valueSat: STRING>>,
    outputs: ARRAY<STRUCT<address: STRING, addresses: ARRAY<STRING>,
                          value: STRING, valueSat: STRING, n: INT>>
"""
RAW_BLOCK = f"""
    height BIGINT, hash STRING, time BIGINT, size BIGINT, txCount INT, tx_count INT,
    tx ARRAY<STRING>,
    txDetails ARRAY<STRUCT<txid: STRING, kind: STRING>>,
    txs ARRAY<STRUCT<{_RAW_TX_FIELDS}>>
"""

LABEL_FILE = """
    exchanges ARRAY<STRUCT<name: STRING, addresses: ARRAY<STRING>, logo: STRING>>,
    foundation STRUCT<name: STRING, addresses: ARRAY<STRING>, logo: STRING>
"""
NODE = "STRUCT<payment_address: STRING, tier: STRING, collateral: STRING>"

BLOCKS = "height BIGINT, hash STRING, time BIGINT, tx_count INT, size BIGINT"

# What is known about the party on one side of an event. Label fields come first,
# the rest is filled by attribution.
DETAIL_FIELDS = {
    "name": "STRING",
    "logo": "STRING",
    "node_count": "BIGINT",
    "tiers": "MAP<STRING, BIGINT>",
    "node_wallet": "STRING",
    "detected_at": "BIGINT",
    "hop_count": "INT",
    "intermediary_txids": "ARRAY<STRING>",
    "detection_method": "STRING",
    "status": "STRING",
    "last_coinbase_block": "BIGINT",
    "coinbase_count": "BIGINT",
    "days_inactive": "BIGINT",
    "connection_txid": "STRING",
    "connection_block": "BIGINT",
    "days_ago": "BIGINT",
    "destination_coinbase_count": "BIGINT",
    "destination_last_coinbase": "BIGINT",
}
PARTY_DETAILS = "STRUCT<" + ", ".join(f"{n}: {t}" for n, t in DETAIL_FIELDS.items()) + ">"

FLOW_EVENTS = f"""
    txid STRING, vout INT, block_height BIGINT, block_time BIGINT, event_seq BIGINT,
    from_address STRING, from_type STRING, from_details {PARTY_DETAILS},
    to_address STRING, to_type STRING, to_details {PARTY_DETAILS},
    flow_type STRING, satoshi DECIMAL(20,0), amount DOUBLE,
    classification_level INT, intermediary_wallet STRING, hop_chain ARRAY<STRING>,
    analysis_timestamp BIGINT, data_source STRING
"""

EVENT_KEY = ["txid", "vout"]
# Newest first inside the whole table.
EVENT_ORDER = ["block_height", "event_seq"]


@dataclass(frozen=True)
class Ledger:
    """A chain in flat form, so that no row grows with the size of a transaction.

    ``txs``      txid, kind, height, block_time, tx_index
    ``inputs``   the same and pos, addr_pos, address, satoshi
    ``outputs``  the same and vout, addr_pos, address, satoshi

    ``inputs`` and ``outputs`` have one row per address; a side without addresses
    keeps one row with a null address, and the amount counts at ``addr_pos`` 0 only.
    """

    txs: DataFrame
    inputs: DataFrame
    outputs: DataFrame

    def filter(self, condition: Column) -> "Ledger":
        """Restrict all three frames by a condition on the shared columns."""
        return Ledger(
            self.txs.filter(condition),
            self.inputs.filter(condition),
            self.outputs.filter(condition),
        )


def details_sql(**given: str) -> str:
    """SQL for a details struct with the given fields set and all others null."""
    unknown = set(given) - set(DETAIL_FIELDS)
    if unknown:
        raise ValueError(f"not a details field: {sorted(unknown)}")
    parts = [f"'{n}', CAST({given.get(n, 'NULL')} AS {t})" for n, t in DETAIL_FIELDS.items()]
    return f"named_struct({', '.join(parts)})"


def details_to_json(details: Column) -> Column:
    """Details as JSON text for export; null fields are left out."""
    return F.to_json(details)


def details_from_json(text: Column) -> Column:
    """Details parsed from JSON text."""
    return F.from_json(text, PARTY_DETAILS)


def chain_from_json(text: Column) -> Column:
    """A hop chain parsed from JSON text; null when it is not a JSON array."""
    return F.from_json(text, "ARRAY<STRING>")

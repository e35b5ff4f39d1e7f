"""Small hand-made ledgers for the tests."""

from ledgerflow.operators.labels import label_dimension, node_operators
from ledgerflow.schemas import Ledger

HEADER = "txid STRING, kind STRING, height BIGINT, block_time BIGINT, tx_index BIGINT"
PARTY = "addr_pos INT, address STRING, satoshi DECIMAL(20,0)"


def ledger(spark, *txs) -> Ledger:
    """Each tx: (txid, height, inputs, outputs[, kind]); a side lists addresses or address lists."""
    heads, ins, outs = [], [], []
    for index, (txid, height, inputs, outputs, *kind) in enumerate(txs):
        head = (txid, kind[0] if kind else "transfer", height, height * 30, index)
        heads.append(head)
        for rows, side in ((ins, inputs), (outs, outputs)):
            for pos, party in enumerate(side):
                addresses = [party] if isinstance(party, str) else list(party)
                for addr_pos, address in enumerate(addresses or [None]):
                    rows.append((*head, pos, addr_pos, address, 100_000_000 * (pos + 1)))
    decimals = lambda rows: [(*r[:-1], __import__("decimal").Decimal(r[-1])) for r in rows]
    return Ledger(
        spark.createDataFrame(heads, HEADER),
        spark.createDataFrame(decimals(ins), f"{HEADER}, pos INT, {PARTY}"),
        spark.createDataFrame(decimals(outs), f"{HEADER}, vout INT, {PARTY}"),
    )


def nodes(spark, *addresses):
    """One node per mention of an address."""
    rows = [(a, "CUMULUS", "1000") for a in addresses]
    return spark.createDataFrame(rows, "payment_address STRING, tier STRING, collateral STRING")


def listed(spark, exchanges=(), foundation=()):
    rows = [(a, "exchange", f"name-{a}", f"logo-{a}", 0) for a in exchanges]
    rows += [(a, "foundation", "Foundation", None, 0) for a in foundation]
    return spark.createDataFrame(
        rows, "address STRING, type STRING, name STRING, logo STRING, position BIGINT"
    )


def labels(spark, exchanges=(), foundation=(), operators=()):
    return label_dimension(listed(spark, exchanges, foundation), node_operators(nodes(spark, *operators)))


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

"""The given star-schema tables seen as a ledger (the mapping of FIXTURES.md).

An order is a transaction, its lines are the outputs, a customer is a wallet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.constants import BLOCK_SECONDS, COINBASE, EXCHANGE, FOUNDATION, TRANSFER
from ledgerflow.functions.scalars import MONEY
from ledgerflow.operators.labels import label_dimension, node_operators
from ledgerflow.operators.numbering import number_rows
from ledgerflow.schemas import Ledger
from ledgerflow.session import materialise

# Columns that number the lines of an order; ties are equal rows.
LINE_ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_shipdate",
]


def height_sql(seconds: str) -> str:
    return f"CAST(floor({seconds} / {BLOCK_SECONDS}) AS BIGINT)"


def epoch_sql(ts: str) -> str:
    """Seconds since 1970 of a timestamp without zone, whatever zone the session has."""
    return f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})"


def satoshi_sql(amount: str) -> str:
    return f"CAST(round({amount} * 1e8D) AS {MONEY})"


# Columns that all three frames of a ledger share.
HEADER = ["txid", "kind", "height", "block_time", "tx_index"]


# Never falls along LINE_ORDER: parts of a crowded order.
LINE_PART = "struct(l_linenumber, l_partkey div 100000 AS parts)"


@dataclass(frozen=True)
class TestLedger:
    """Lazy frames over one scale-factor folder; each property is only a plan."""

    __test__ = False

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def customers(self) -> DataFrame:
        return self.table("customer")

    @cached_property
    def wallet_count(self) -> Column:
        """Number of wallets, as an uncorrelated scalar subquery."""
        return self.customers.selectExpr("count(*)").scalar()

    @cached_property
    def _orders(self) -> DataFrame:
        seconds = epoch_sql("o_orderdate")
        return self.table("orders").selectExpr(
            "concat('T', o_orderkey) AS txid",
            f"""CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 < 5 THEN '{COINBASE}'
                     WHEN o_orderpriority = '5-LOW' AND o_orderkey % 10 = 5 THEN 'confirm'
                     ELSE '{TRANSFER}' END AS kind""",
            f"{height_sql(seconds)} AS height",
            f"{seconds} AS block_time",
            "o_orderkey AS tx_index",
            "o_custkey",
            "o_totalprice",
        )

    @cached_property
    def ledger(self) -> Ledger:
        txs = self.ledger_txs
        first = f"named_struct('pos', 0, 'key', o_custkey, 'satoshi', {satoshi_sql('o_totalprice')})"
        second = f"named_struct('pos', 1, 'key', (o_custkey + 1) % wallets, 'satoshi', CAST(0 AS {MONEY}))"
        inputs = (
            self._orders.filter(f"kind <> '{COINBASE}'")
            .withColumn("wallets", self.wallet_count)
            .selectExpr(*HEADER, f"explode(if(tx_index % 7 = 0, array({first}, {second}), array({first}))) AS s")
            .selectExpr(*HEADER, "s.pos", "0 AS addr_pos", "concat('W', s.key) AS address", "s.satoshi")
        )
        numbered = number_rows(self._lines, "txid", LINE_ORDER, LINE_PART, "vout")
        return Ledger(txs, inputs, self._outputs(numbered))

    @cached_property
    def unnumbered(self) -> Ledger:
        """The ledger with null output numbers, for answers that use none.

        Here outputs are numbered by sorting lines, a cost that a chain, which comes
        numbered, does not have.
        """
        led = self.ledger
        return Ledger(led.txs, led.inputs, self._outputs(self._lines.withColumn("vout", F.lit(None).cast("int"))))

    @cached_property
    def _lines(self) -> DataFrame:
        return self.table("lineitem").selectExpr("concat('T', l_orderkey) AS txid", *LINE_ORDER)

    def _outputs(self, lines: DataFrame) -> DataFrame:
        return (
            lines.withColumn("wallets", self.wallet_count)
            .selectExpr(
                "txid",
                "vout",
                "0 AS addr_pos",
                "concat('W', (l_partkey * 7 + l_suppkey) % wallets) AS address",
                f"{satoshi_sql('l_extendedprice')} AS satoshi",
            )
            .join(self.ledger_txs, "txid")
            .select(*HEADER, "vout", "addr_pos", "address", "satoshi")
        )

    @cached_property
    def ledger_txs(self) -> DataFrame:
        return self._orders.select(*HEADER)

    def stored(self) -> "TestLedger":
        """The same tables with the ledger written out, for jobs that read it often."""
        led = self.ledger
        copy = TestLedger(self.spark, self.sf_dir)
        copy.__dict__["ledger"] = copy.__dict__["unnumbered"] = Ledger(
            led.txs, materialise(led.inputs, "inputs"), materialise(led.outputs, "outputs")
        )
        return copy

    @cached_property
    def listed(self) -> DataFrame:
        """Exchange and foundation addresses, as ``read_labels`` would give them."""
        return self.customers.filter("c_custkey % 25 < 6").selectExpr(
            "concat('W', c_custkey) AS address",
            f"if(c_custkey % 25 < 4, '{EXCHANGE}', '{FOUNDATION}') AS type",
            """CASE WHEN c_custkey % 25 = 0 THEN 'EX_A' WHEN c_custkey % 25 = 1 THEN 'EX_B'
                    WHEN c_custkey % 25 < 4 THEN 'EX_C' ELSE 'Foundation' END AS name""",
            "CAST(NULL AS STRING) AS logo",
            "0L AS position",
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """The node registry, one row per node."""
        return (
            self.customers.filter("c_mktsegment = 'MACHINERY'")
            .selectExpr("c_custkey", "explode(sequence(0L, c_custkey % 3)) AS copy")
            .selectExpr(
                "concat('W', c_custkey) AS payment_address",
                """CASE WHEN c_custkey % 10 < 6 THEN 'CUMULUS' WHEN c_custkey % 10 < 9 THEN 'NIMBUS'
                        ELSE 'STRATUS' END AS tier""",
                """CASE WHEN c_custkey % 10 < 6 THEN '1000' WHEN c_custkey % 10 < 9 THEN '12500'
                        ELSE '40000' END AS collateral""",
            )
        )

    @cached_property
    def operators(self) -> DataFrame:
        return node_operators(self.nodes)

    @cached_property
    def labels(self) -> DataFrame:
        return label_dimension(self.listed, self.operators)

    @cached_property
    def blocks(self) -> DataFrame:
        """One block per height that has an order."""
        return self._orders.groupBy("height").agg(
            F.expr("min(block_time) AS time"), F.expr("CAST(count(*) AS INT) AS tx_count")
        )

    @cached_property
    def event_blocks(self) -> DataFrame:
        """A second chain, dense in height, from the event stream."""
        return (
            self.table("events")
            .selectExpr(f"{height_sql(epoch_sql('ts'))} AS height")
            .groupBy("height")
            .agg(F.expr("CAST(count(*) AS INT) AS tx_count"))
        )

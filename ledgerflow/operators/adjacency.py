"""Histories and hop edges as maintained tables.

Attribution asks for few wallets at a time. Its evidence is kept in tables bucketed by exactly
what a lookup asks for, so a run shuffles the wallets it asks for and nothing of the chain:

``history``   direction, wallet and window of heights; what a wallet did inside a window
``receipts``  wallet and window; coinbase receipts per height
``earners``   wallet; who ever had a receipt
``mentions``  txid; the addresses of a transaction, per direction
``sent``, ``received``  the hop index of either direction, by its key

No key grows with a busy wallet: it holds a window of heights, or at most 256 blocks. A batch of
transactions is a partition of every table, so new batches are appended and a repeated one
replaces itself. The files of a bucket are read together, whatever their batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.constants import BUYING, EVIDENCE_WINDOW, RECEIVED, SENT
from ledgerflow.operators.attribution import SIDES, Evidence
from ledgerflow.operators.history import (
    PROBE,
    _asked,
    _hop,
    bucket_sql,
    coinbase_receipts,
    first_mentions,
    hop_edges,
    hop_index,
    search,
    wallet_history,
)
from ledgerflow.schemas import Ledger
from ledgerflow.session import drop_path, materialise, shuffles_dropped, written

# Table and the column it is bucketed and sorted by.
TABLES = {"history": "key", "receipts": "key", "earners": "wallet", "mentions": "txid", SENT: "key", RECEIVED: "key"}


def _windows(points: DataFrame, who: list[str], window: int) -> DataFrame:
    """The keys whose rows a point may see: those of its own window of heights and the one before."""
    bucket = bucket_sql("height", window)
    seen = points.selectExpr(*who, f"explode(array({bucket}, {bucket} - 1)) AS seen")
    return seen.selectExpr(f"concat_ws('|', seen, {', '.join(who)}) AS key").distinct()


@dataclass(frozen=True)
class Adjacency(Evidence):
    """Evidence out of the tables ``<name>_<table>`` of the session's catalog.

    ``window`` is the widest window of heights that lookups may ask for.
    """

    spark: SparkSession | None = None
    name: str = "ledger"
    buckets: int = 64
    window: int = EVIDENCE_WINDOW

    @staticmethod
    def of(spark: SparkSession, name: str, operators: DataFrame, buckets: int = 64, window: int = EVIDENCE_WINDOW) -> Adjacency:
        return Adjacency(None, None, operators, None, spark, name, buckets, window)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}").drop("batch")

    def extend(self, led: Ledger, batch: str) -> None:
        """Add a batch of transactions, or put it in the place of what the batch held before.

        A transaction belongs to one batch. Everything derived here is local to a transaction
        or, as the index and the receipts, adds up over batches.
        """
        token = written.set(inside := [])
        try:
            self._extend(led, batch)
        finally:
            written.reset(token)
            for path in inside:
                drop_path(self.spark, path)

    def _extend(self, led: Ledger, batch: str) -> None:
        history = materialise(wallet_history(led), "history")
        keyed = f"concat_ws('|', {bucket_sql('height', self.window)}, direction, wallet) AS key"
        receipts = coinbase_receipts(history)
        rows = {
            "history": history.filter("NOT is_coinbase").selectExpr(keyed, "direction", "wallet", "height", "tx_index", "txid"),
            "receipts": receipts.selectExpr(f"concat_ws('|', {bucket_sql('height', self.window)}, wallet) AS key", "wallet", "height", "receipts"),
            "earners": receipts.select("wallet").distinct(),
            "mentions": first_mentions(led),
            SENT: hop_index(hop_edges(history, led, SENT), self.buckets),
            RECEIVED: hop_index(hop_edges(history, led, RECEIVED), self.buckets),
        }
        for table, key in TABLES.items():
            full = f"{self.name}_{table}"
            made = rows[table].withColumn("batch", F.lit(batch))
            # One file per bucket and batch; one per level of an index, which is dealt already.
            if table not in (SENT, RECEIVED):
                made = made.repartition(self.buckets, key)
            if not self.spark.catalog.tableExists(full):
                made.limit(0).write.format("parquet").partitionBy("batch").bucketBy(self.buckets, key).sortBy(key).saveAsTable(full)
            columns = [c for c in self.spark.table(full).columns if c != "batch"]
            # The batch's own partition, whatever the session's overwrite mode is.
            with shuffles_dropped(self.spark):
                self.spark.sql(f"INSERT OVERWRITE TABLE {full} PARTITION (batch = :batch) SELECT * FROM {{rows}}", args={"batch": batch}, rows=made.select(*columns))

    # What attribution asks for.

    def past(self, points: DataFrame, window: int) -> DataFrame:
        if window > self.window:
            raise ValueError(f"the tables are kept for windows of at most {self.window} heights")
        wanted = _windows(points, ["direction", "wallet"], self.window)
        return self.table("history").join(wanted, "key", "left_semi").select("direction", "wallet", "height", "tx_index", "txid")

    def mentions(self, txids: DataFrame) -> DataFrame:
        return self.table("mentions").join(txids, "txid", "left_semi")

    def earners(self) -> DataFrame:
        return self.table("earners").distinct()

    def receipts_of(self, asked: DataFrame, window: int) -> DataFrame:
        if window > self.window:
            raise ValueError(f"the tables are kept for windows of at most {self.window} heights")
        seen = self.table("receipts").join(_windows(asked, ["wallet"], self.window), "key", "left_semi")
        return seen.groupBy("wallet", "height").agg(F.sum("receipts").alias("receipts"))

    def hopper(self, side: str):
        index = self.table(SIDES[side])
        if side == BUYING:
            return lambda asked: _hop(search(_asked(asked), index, later=True, anywhere=True).filter("edge.hop_height > height"))
        return lambda asked: _hop(search(_asked(asked), index, later=False))

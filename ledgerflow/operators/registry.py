"""Node operators by version: what a batch knew stays what it knows.

Every refresh of the registry is a version, stored as the operators that differ from the one
before it. A batch of ingest is bound to the newest version when it first runs; when it is
repeated, after a crash or a restart, it gets the same labels again, whatever came since.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.labels import label_dimension
from ledgerflow.operators.tables import read_table

FACTS = ["node_count", "tiers", "total_collateral"]
OPERATORS = "address STRING, node_count BIGINT, tiers MAP<STRING, BIGINT>, total_collateral DOUBLE"
CHANGES = f"{OPERATORS}, gone BOOLEAN, version BIGINT"

# Every so many versions the whole list is stored, so reading one opens a bounded number of them.
FULL_EVERY = 144


class Registry:
    """The versions of a node registry in one folder; one process at a time may refresh it."""

    def __init__(self, spark: SparkSession, path: str, full_every: int = FULL_EVERY):
        self.spark, self.path, self.full_every = spark, path, full_every

    def _stored(self, name: str, schema: str) -> DataFrame:
        frame = read_table(self.spark, f"{self.path}/{name}")
        if frame is None:
            return self.spark.createDataFrame([], schema)
        return frame.withColumn("version", F.col("version").cast("bigint"))

    def versions(self) -> DataFrame:
        """version, and whether it holds the whole list. A version counts once it is listed here."""
        return self._stored("versions", "full BOOLEAN, version BIGINT")

    def as_of(self, version: int | Column) -> DataFrame:
        """The operators of the newest version up to ``version``; none before the first."""
        version = F.lit(version) if isinstance(version, int) else version
        listed = self.versions().filter(F.col("version") <= version)
        newest = F.coalesce(F.max("version"), F.lit(0))
        changes = self._stored("changes", CHANGES).filter(
            F.col("version").between(listed.filter("full").agg(newest).scalar(), listed.agg(newest).scalar())
        )
        last = changes.groupBy("address").agg(F.max_by(F.struct(*FACTS, "gone"), "version").alias("last"))
        return last.filter("NOT last.gone").select("address", *[f"last.{c}" for c in FACTS])

    def refresh(self, operators: DataFrame, version: int) -> bool:
        """Store ``operators`` as a version; versions rise, e.g. the second of the refresh.

        A refresh that brings no operator leaves the list as it is, and so does a version that
        is stored already: a repeated refresh changes nothing. Returns whether it was stored.
        """
        versions = self.versions()
        if operators.isEmpty() or not versions.filter(F.col("version") == version).isEmpty():
            return False
        if not versions.filter(F.col("version") > version).isEmpty():
            raise ValueError(f"version {version} is older than the newest one")
        last_full = versions.filter("full").agg(F.coalesce(F.max("version"), F.lit(0))).scalar()
        full = versions.filter(F.col("version") >= last_full).count() % self.full_every == 0
        self._changes(operators, version, full).write.mode("overwrite").parquet(f"{self.path}/changes/version={version}")
        done = self.spark.range(1).select(F.lit(full).alias("full"))
        done.write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")
        return True

    def _changes(self, operators: DataFrame, version: int, full: bool) -> DataFrame:
        def facts(side: str) -> Column:  # maps have no order of their own
            tiers = F.array_sort(F.map_entries(f"{side}.tiers"))
            return F.struct(f"{side}.address", f"{side}.node_count", tiers, f"{side}.total_collateral")

        both = self.as_of(version - 1).alias("o").join(
            operators.alias("n"), F.col("o.address") == F.col("n.address"), "full"
        )
        gone = F.col("n.address").isNull()
        kept = ~gone if full else ~facts("o").eqNullSafe(facts("n"))
        return both.filter(kept).select(
            F.coalesce("n.address", "o.address").alias("address"), *[F.col(f"n.{c}").alias(c) for c in FACTS], gone.alias("gone")
        )

    def of_batch(self, batch: str) -> DataFrame:
        """The operators that ``batch`` is bound to; binds it to the newest version if it is new."""
        bound = f"{self.path}/batches/batch={batch}"
        if read_table(self.spark, bound) is None:
            newest = self.versions().agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
            newest.write.mode("overwrite").parquet(bound)
        return self.as_of(self.spark.read.schema("version BIGINT").parquet(bound).scalar())


@dataclass(frozen=True)
class BatchLabels:
    """Labels for ingest: listed addresses, and the operators of each batch's own version."""

    registry: Registry
    listed: Callable[[], DataFrame]

    def of_batch(self, batch: str) -> DataFrame:
        return label_dimension(self.listed(), self.registry.of_batch(batch))

"""Attribution that lands: every run's outcome is appended beside the stored events.

An attempt names the columns it sets in ``updates``; a failed one only its time. Events are
never rewritten for it: reading folds the attempts of a key column by column, the newest one
that names a column wins. The next run reads the same fold, so an event that was settled is
not asked again and one that was not rests for the cool-down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.constants import BUYING, DEFAULT_DEPTH, MIN_CANDIDATES, RETRY_HOURS, SELLING, UNKNOWN
from ledgerflow.operators.attribution import (
    OVERLAY_FIELDS,
    Evidence,
    apply_overlay,
    attribute_candidates,
    attribution_report,
    stored_candidates,
)
from ledgerflow.operators.tables import drop_path, read_table
from ledgerflow.schemas import EVENT_KEY
from ledgerflow.session import distilled, shuffles_dropped

# Of an attempt's own, not of the event.
OUTCOME = ("side", "method", "status", "level", "cycle")


def folded(attempts: DataFrame) -> DataFrame:
    """One overlay row per event: each column from the newest attempt that sets it.

    Attempts fold as partial aggregates, so a key with many of them sends one row per task.
    """

    def newest(column: str):
        at = F.when(F.array_contains("updates", F.lit(column)), F.col("run"))
        # In a struct, so that a column set to null counts as set.
        return F.max_by(F.struct(F.col(column).alias("v")), at)["v"].alias(column)

    named = [F.max(F.when(F.array_contains("updates", F.lit(c)), F.lit(c))).alias(f"_{c}") for c in OVERLAY_FIELDS]
    found = attempts.groupBy(*EVENT_KEY).agg(*map(newest, OVERLAY_FIELDS), *named)
    return found.select(*EVENT_KEY, *OVERLAY_FIELDS, F.array_compact(F.array(*[f"_{c}" for c in OVERLAY_FIELDS])).alias("updates"))


def open_events(ev: DataFrame, attempts: DataFrame | None) -> DataFrame:
    """The unresolved events of a stored table as its attempts leave them.

    Only events with an open side meet the attempts, on their key; the filter reaches the scan.
    """
    party = F.when(F.col("flow_type") == BUYING, F.col("to_type")).when(F.col("flow_type") == SELLING, F.col("from_type"))
    unresolved = ev.filter((party == UNKNOWN) & (F.col("classification_level") == 0))
    return unresolved if attempts is None else apply_overlay(unresolved, folded(attempts))


@dataclass(frozen=True)
class AttributedEvents:
    """A stored event table and the folder of its attempts, one partition per run."""

    spark: SparkSession
    events_path: str
    attempts_path: str

    def attempts(self) -> DataFrame | None:
        return read_table(self.spark, self.attempts_path)

    def events(self) -> DataFrame:
        """All events with what attribution has found so far."""
        ev = self.spark.read.parquet(self.events_path).drop("height_bucket")
        tried = self.attempts()
        return ev if tried is None else apply_overlay(ev, folded(tried))

    def record(self, overlay: DataFrame, run: int) -> DataFrame:
        """Store a run's outcome. A repeated run replaces its own partition, nothing else."""
        with shuffles_dropped(self.spark):
            (
                overlay.withColumn("run", F.lit(run).cast("bigint"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("run")
                .parquet(self.attempts_path)
            )
        return self.spark.read.schema(overlay.schema).parquet(f"{self.attempts_path}/run={run}")

    def cycle(
        self,
        evidence: Evidence,
        now: int,
        min_candidates: int = MIN_CANDIDATES,
        max_depth: int = DEFAULT_DEPTH,
        retry_hours: int = RETRY_HOURS,
    ) -> DataFrame | None:
        """One run over the events that are due: stores its attempts and returns the report, or
        None below ``min_candidates``. Only the size of the queue comes to the driver.

        What this very run stored before, if it died on the way, does not count as an attempt.
        """
        ev = self.spark.read.parquet(self.events_path).drop("height_bucket")
        tried = self.attempts()
        due = open_events(ev, None if tried is None else tried.filter(F.col("run") < now))
        # Stored first: their number is the size of the queue, and the events are read once.
        candidates = stored_candidates(due, now, retry_hours)
        if candidates.count() < min_candidates:
            return None
        overlay = distilled(lambda: attribute_candidates(candidates, evidence, now, max_depth), "overlay")
        return attribution_report(self.record(overlay, now))

    def compact(self, upto: int) -> None:
        """Fold all runs up to ``upto`` into one partition. Settled columns keep their values, so
        reading before, during and after gives the same; old partitions go last."""
        tried = self.attempts()
        old = tried.filter(F.col("run") <= upto)
        runs = [r.run for r in old.select("run").distinct().orderBy("run").take(100_000)]
        if len(runs) < 2:
            return
        rows = folded(old)
        lost = {c: F.lit(None).cast(tried.schema[c].dataType).alias(c) for c in OUTCOME}
        merged = rows.select("*", *lost.values()).select(*[c for c in tried.columns if c != "run"])
        self.record(merged, runs[-1])
        for run in runs[:-1]:
            drop_path(self.spark, f"{self.attempts_path}/run={run}")

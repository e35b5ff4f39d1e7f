"""The attribution cycle over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerflow.constants import DEFAULT_DEPTH, MIN_CANDIDATES, RETRY_HOURS
from ledgerflow.operators.attribution import (
    Evidence,
    apply_overlay,
    attribute_unknowns,
    attribution_report,
    unknown_stats,
)
from ledgerflow.session import distilled


def attribution_cycle(
    ev: DataFrame,
    evidence: Evidence,
    now: int,
    min_candidates: int = MIN_CANDIDATES,
    max_depth: int = DEFAULT_DEPTH,
    retry_hours: int = RETRY_HOURS,
    cap: int | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """One run: the updated events and the report, or None below ``min_candidates``.

    Only the size of the queue, a single number, comes to the driver.
    """
    queue = unknown_stats(ev, now).select("total_unknowns").first()
    if queue["total_unknowns"] < min_candidates:
        return None
    overlay = distilled(lambda: attribute_unknowns(ev, evidence, now, max_depth, retry_hours, cap), "overlay")
    return apply_overlay(ev, overlay), attribution_report(overlay)

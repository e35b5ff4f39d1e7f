"""Label configuration and node registry files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.constants import EXCHANGE, FOUNDATION
from ledgerflow.schemas import LABEL_FILE, NODE


def read_labels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Exchange and foundation addresses: address, type, name, logo, position.

    A file holds one document, or with ``lines`` one document per line.
    ``position`` is the place of the exchange in the file; of two that list the same
    address the later one counts.
    """
    config = spark.read.schema(LABEL_FILE).json(path, multiLine=not lines)
    exchanges = config.select(F.posexplode("exchanges").alias("position", "e")).select(
        F.explode("e.addresses").alias("address"),
        F.lit(EXCHANGE).alias("type"),
        F.col("e.name").alias("name"),
        F.col("e.logo").alias("logo"),
        F.col("position").cast("bigint").alias("position"),
    )
    foundation = config.select(
        F.explode("foundation.addresses").alias("address"),
        F.lit(FOUNDATION).alias("type"),
        F.col("foundation.name").alias("name"),
        F.col("foundation.logo").alias("logo"),
        F.lit(0).cast("bigint").alias("position"),
    )
    return exchanges.unionByName(foundation).distinct()


# Where a registry document holds its nodes, unless the caller names other keys.
REGISTRY_KEYS = ("nodes",)


def parse_node_registry(text: Column, keys: Sequence[str] = REGISTRY_KEYS) -> Column:
    """Nodes of one registry document, as an array.

    Accepts a bare array, or an object with an array under one of ``keys``; the first of
    them that holds an array counts, so a count beside the list does no harm.
    """
    nodes = f"array<{NODE}>"
    wrapped = F.from_json(text, "map<string,string>")
    lists = [F.when(F.ltrim(v).startswith("["), v) for v in (F.try_element_at(wrapped, F.lit(k)) for k in keys)]
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, nodes)).otherwise(
        F.from_json(F.coalesce(*lists), nodes)
    )


def read_node_registry(
    spark: SparkSession, path: str, lines: bool = False, keys: Sequence[str] = REGISTRY_KEYS
) -> DataFrame:
    """One row per node: payment_address, tier, collateral. Empty if there is none.

    A file holds one document, or with ``lines`` one document per line.
    """
    document = spark.read.text(path, wholetext=not lines)
    return document.select(F.inline(parse_node_registry(F.col("value"), keys)))


def refreshed_operators(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` operators, or the current ones when the refresh brought none."""
    any_fresh = fresh.agg(F.count("*")).scalar() > 0
    return fresh.unionByName(current.filter(~any_fresh))

"""Address labels, node operators and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.constants import DEFAULT_TIER, EXCHANGE, FOUNDATION, NODE_OPERATOR, TIERS, UNKNOWN
from ledgerflow.functions.scalars import leading_number
from ledgerflow.operators.scans import positive
from ledgerflow.schemas import details_sql


def node_operators(nodes: DataFrame) -> DataFrame:
    """One row per payment address: node count, tier counts, summed collateral.

    Counting per (address, tier) first keeps an operator that owns a large share of
    all nodes from meeting in one task.
    """
    per_tier = (
        nodes.filter("length(payment_address) > 0")
        .select(
            F.col("payment_address").alias("address"),
            F.expr(f"coalesce(nullif(tier, ''), '{DEFAULT_TIER}')").alias("tier"),
            F.coalesce(leading_number(F.col("collateral")), F.lit(0.0)).alias("collateral"),
        )
        .groupBy("address", "tier")
        .agg(F.expr("count(*) AS nodes"), F.expr("sum(collateral) AS collateral"))
    )
    known = ", ".join(f"'{t}'" for t in TIERS)
    standard = ", ".join(f"'{t}', {t}" for t in TIERS)
    return (
        per_tier.groupBy("address")
        .agg(
            F.expr("sum(nodes) AS node_count"),
            F.expr("sum(collateral) AS total_collateral"),
            F.expr(
                f"collect_list(named_struct('tier', tier, 'nodes', nodes)) FILTER (WHERE tier NOT IN ({known})) AS other"
            ),
            *[F.expr(f"sum(if(tier = '{t}', nodes, 0)) AS {t}") for t in TIERS],
        )
        .selectExpr(
            "address",
            "node_count",
            f"map_concat(map({standard}), map_from_entries(other)) AS tiers",
            "total_collateral",
        )
    )


def label_dimension(listed: DataFrame, operators: DataFrame) -> DataFrame:
    """One row per labelled address: address, type, details.

    ``listed`` has address, type, name, logo and position, as ``read_labels`` gives
    it. Exchange beats foundation beats node operator; of two exchanges that list
    the same address the later one wins. The details have only the fields their
    type has.
    """
    rows = listed.selectExpr(
        "address",
        "type",
        f"named_struct('rank', if(type = '{EXCHANGE}', 1, 2), 'at', -position) AS precedence",
        "name",
        f"if(type = '{EXCHANGE}', logo, NULL) AS logo",
        "CAST(NULL AS BIGINT) AS node_count",
        "CAST(NULL AS MAP<STRING, BIGINT>) AS tiers",
    ).union(
        operators.selectExpr(
            "address",
            f"'{NODE_OPERATOR}'",
            "named_struct('rank', 3, 'at', 0L)",
            "CAST(NULL AS STRING)",
            "CAST(NULL AS STRING)",
            "node_count",
            "tiers",
        )
    )
    best = "min_by(struct(type, name, logo, node_count, tiers), precedence) AS l"
    fields = {f: f"l.{f}" for f in ("name", "logo", "node_count", "tiers")}
    return (
        rows.groupBy("address")
        .agg(F.expr(best))
        .selectExpr("address", "l.type AS type", f"{details_sql(**fields)} AS details")
    )


def classify_addresses(df: DataFrame, address_col: str, labels: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``{prefix}type`` and ``{prefix}details`` by looking an address up.

    No broadcast hint: the planner broadcasts the labels when their measured size
    allows it and otherwise shuffles, where AQE splits the partition of a busy
    address.
    """
    looked_up = labels.selectExpr(
        "address AS _label_address", "type AS _label_type", f"details AS {prefix}details"
    )
    return df.join(looked_up, F.col(address_col) == F.col("_label_address"), "left").selectExpr(
        *df.columns, f"coalesce(_label_type, '{UNKNOWN}') AS {prefix}type", f"{prefix}details"
    )


def label_stats(listed: DataFrame, operators: DataFrame) -> DataFrame:
    """Exchange address count and names, foundation, operator, node and tier counts.

    The exchange count is a count of addresses; the name list has one entry per
    distinct exchange.
    """
    addresses = listed.groupBy("type", "address").agg(F.max_by("name", "position").alias("name"))
    rows = addresses.select(
        "type", "name", F.lit(0).cast("bigint").alias("node_count"), F.lit(None).cast("map<string,bigint>").alias("tiers")
    ).unionByName(
        operators.select(F.lit(NODE_OPERATOR).alias("type"), F.lit(None).cast("string").alias("name"), "node_count", "tiers")
    )
    exchange_name = F.when(F.col("type") == EXCHANGE, F.col("name"))
    return rows.agg(
        F.count_if(F.col("type") == EXCHANGE).alias("exchange_count"),
        F.array_join(F.array_sort(F.collect_set(exchange_name)), ",").alias("exchange_names"),
        F.count_if(F.col("type") == FOUNDATION).alias("foundation_count"),
        F.count_if(F.col("type") == NODE_OPERATOR).alias("operator_count"),
        F.coalesce(F.sum("node_count"), F.lit(0)).alias("total_nodes"),
        *[
            F.coalesce(F.sum(F.try_element_at("tiers", F.lit(t))), F.lit(0)).alias(f"{t.lower()}_nodes")
            for t in TIERS
        ],
    )


def top_node_operators(operators: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` operators with most nodes; ties by address."""
    return operators.orderBy(F.desc("node_count"), "address").limit(positive(n))

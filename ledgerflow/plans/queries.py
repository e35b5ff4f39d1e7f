"""The library's answers over the given tables, one callable per operator.

Every callable takes (spark, sf_dir), reads whole tables and returns a flat frame:
nested values are spelled out as columns or joined texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.constants import BUCKET_BLOCKS, BUYING, PERIODS, RECEIVED, SELLING, SENT, SIX_MONTHS, TIERS
from ledgerflow.functions import scalars
from ledgerflow.operators import (
    adjacency,
    attempts,
    attribution,
    coverage,
    events,
    history,
    labels,
    periods,
    rollup,
    scans,
    summary,
    tables,
    txview,
    views,
)
from ledgerflow.operators.registry import BatchLabels, Registry
from ledgerflow.schemas import EVENT_KEY, Ledger, details_from_json, details_to_json
from ledgerflow.session import distilled, materialise, shared_dir, shuffles_dropped
from ledgerflow.sources import chain
from ledgerflow.sources.labels import read_labels, read_node_registry
from ledgerflow.sources.testdata import LINE_ORDER, TestLedger
from ledgerflow.streaming import ingest, relevance, totals

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}

# The moment of analysis; nothing in the data is analysed before it.
NOW = 1_700_000_000


def query(fn: Callable[[TestLedger], DataFrame]) -> Callable[[TestLedger], DataFrame]:
    """Register a query under the name of its function."""
    _REGISTERED[fn.__name__] = lambda spark, sf_dir: fn(TestLedger(spark, sf_dir))
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


def joined(column: str | Column) -> Column:
    """An array as comma-joined text; null stays null."""
    return F.array_join(column, ",")


def tier_text(tiers: Column) -> Column:
    """Tier counts as text, in the fixed order of tiers."""
    return F.when(
        tiers.isNotNull(), F.concat_ws("/", *[F.try_element_at(tiers, F.lit(t)).cast("string") for t in TIERS])
    )


def all_events(t: TestLedger) -> DataFrame:
    return events.build_flow_events(t.ledger, t.labels)


def plain_events(t: TestLedger) -> DataFrame:
    """All events, for answers that do not need to tell outputs apart."""
    return events.build_flow_events(t.unnumbered, t.labels)


def period_events(t: TestLedger, period: str, numbered: bool = False) -> DataFrame:
    """The events of a period, built from that part of the ledger only."""
    led = t.ledger if numbered else t.unnumbered
    return events.build_flow_events(periods.ledger_slice(led, t.blocks, period), t.labels)


def flat_events(ev: DataFrame) -> DataFrame:
    """Events with their details spelled out."""

    def details(side: str) -> list[Column]:
        d = F.col(f"{side}_details")
        return [
            d["name"].alias(f"{side}_name"),
            d["node_count"].alias(f"{side}_nodes"),
            tier_text(d["tiers"]).alias(f"{side}_tiers"),
        ]

    return ev.select(
        "txid", "vout", "block_height", "block_time", "event_seq",
        "from_address", "from_type", *details("from"),
        "to_address", "to_type", *details("to"),
        "flow_type", "amount", "classification_level", "data_source",
    )


# ------------------------------------------------------------------ events


@query
def flow_events(t: TestLedger) -> DataFrame:
    return flat_events(all_events(t))


@query
def classify_addresses(t: TestLedger) -> DataFrame:
    out = events.explode_outputs(t.ledger).select("txid", "vout", "address")
    return labels.classify_addresses(out, "address", t.labels).select(
        "txid", "vout", "address", "type", F.col("details.name").alias("name"),
        F.col("details.node_count").alias("nodes"),
    )


@query
def primary_input(t: TestLedger) -> DataFrame:
    led = events.transfers_only(t.unnumbered)
    return events.primary_input(led, t.labels).select(
        "txid", "from_address", "from_type", F.col("from_details.name").alias("from_name")
    )


@query
def relevant_transactions(t: TestLedger) -> DataFrame:
    return events.relevant_only(events.transfers_only(t.unnumbered), t.labels).txs


@query
def cap_per_block(t: TestLedger) -> DataFrame:
    capped = events.cap_per_block(t.ledger, 3)
    return capped.txs.select("txid", "height", "tx_index")


@query
def relevance_rate(t: TestLedger) -> DataFrame:
    return events.relevance_rate(t.unnumbered, t.labels)


@query
def tx_totals(t: TestLedger) -> DataFrame:
    return events.tx_totals(t.unnumbered)


@query
def flow_events_between(t: TestLedger) -> DataFrame:
    led = t.ledger.filter(F.col("height").between(28_000_000, 29_000_000))
    ev = events.build_flow_events(led, t.labels)
    return flat_events(scans.flow_events_between(ev, 28_000_000, 29_000_000))


@query
def drill_down_buying_unknown(t: TestLedger) -> DataFrame:
    found = summary.drill_down(all_events(t), BUYING, "unknown")
    return found.select("txid", "vout", "block_height", "from_address", "to_address", "amount")


# ------------------------------------------------------------------ periods


@query
def flow_summary_90d(t: TestLedger) -> DataFrame:
    return summary.flow_summary(period_events(t, "90D"))


@query
def flow_breakdown_90d(t: TestLedger) -> DataFrame:
    return summary.flow_breakdown(period_events(t, "90D"))


@query
def by_exchange_90d(t: TestLedger) -> DataFrame:
    return summary.by_exchange(period_events(t, "90D"))


@query
def net_flow_30d(t: TestLedger) -> DataFrame:
    return summary.net_flow(period_events(t, "30D"))


@query
def net_flow_all_periods(t: TestLedger) -> DataFrame:
    return summary.net_flow_all_periods(period_events(t, "6M"), t.blocks)


@query
def event_range_90d(t: TestLedger) -> DataFrame:
    return summary.event_range(period_events(t, "90D"))


def _with_exchanges(top: DataFrame) -> DataFrame:
    return top.withColumn("exchanges", joined("exchanges"))


@query
def top_buyers_6m(t: TestLedger) -> DataFrame:
    return _with_exchanges(summary.top_buyers(period_events(t, "6M", numbered=True)))


@query
def top_sellers_6m(t: TestLedger) -> DataFrame:
    return _with_exchanges(summary.top_sellers(period_events(t, "6M", numbered=True)))


def stored_event_table(t: TestLedger) -> DataFrame:
    """The events as ingest keeps them: a table in partitions of a week of heights."""
    path = f"{landing(t)}/flow_events"
    ev = all_events(t)
    tables.write_buckets(ev.withColumn("height_bucket", coverage.height_bucket(F.col("block_height"))), path, "block_height")
    return t.spark.read.parquet(path)


@query
def flow_summary_stored(t: TestLedger) -> DataFrame:
    return summary.flow_summary(periods.period_slice(stored_event_table(t), t.blocks, "90D"))


@query
def net_flow_stored(t: TestLedger) -> DataFrame:
    return summary.net_flow(periods.period_slice(stored_event_table(t), t.blocks, "30D"))


@query
def top_buyers_stored(t: TestLedger) -> DataFrame:
    return _with_exchanges(summary.top_buyers(periods.period_slice(stored_event_table(t), t.blocks, "6M")))


@query
def flow_summary_rollup(t: TestLedger) -> DataFrame:
    """The last 90 days from stored partial aggregates."""
    path = f"{landing(t)}/rollup"
    rollup.write_rollup(rollup.flow_rollup(plain_events(t)), path)
    newest = periods.tip(t.blocks)
    return rollup.flow_summary_between(t.spark.read.parquet(path), newest - PERIODS["90D"], newest)


@query
def top_buyers_rollup(t: TestLedger) -> DataFrame:
    path = f"{landing(t)}/rollup"
    rollup.write_rollup(rollup.party_rollup(all_events(t)), path)
    newest = periods.tip(t.blocks)
    return _with_exchanges(rollup.top_parties_between(t.spark.read.parquet(path), BUYING, newest - PERIODS["6M"], newest))


@query
def lookup_stored(t: TestLedger) -> DataFrame:
    """The events of a transaction in a stored table."""
    return scans.lookup(stored_event_table(t), txid="T7").select("txid", "vout", "block_height", "to_address", "amount")


@query
def tx_in_block(t: TestLedger) -> DataFrame:
    """The transactions of the newest block."""
    tx = classified(t)[0]
    return tx.filter(F.col("block_height") == periods.tip(t.blocks)).select("txid", "block_height", "total_value")


@query
def sentiment_all_periods(t: TestLedger) -> DataFrame:
    return summary.sentiment_all_periods(period_events(t, "6M"), t.blocks)


@query
def category_series_6m(t: TestLedger) -> DataFrame:
    return summary.category_series(period_events(t, "6M"))


@query
def flow_type_stats(t: TestLedger) -> DataFrame:
    return summary.flow_type_stats(plain_events(t))


# ------------------------------------------------------------------ registry, coverage


@query
def node_operators(t: TestLedger) -> DataFrame:
    return t.operators.select("address", "node_count", tier_text(F.col("tiers")).alias("tiers"), "total_collateral")


@query
def label_stats(t: TestLedger) -> DataFrame:
    return labels.label_stats(t.listed, t.operators)


@query
def top_node_operators(t: TestLedger) -> DataFrame:
    return labels.top_node_operators(t.operators).select(
        "address", "node_count", tier_text(F.col("tiers")).alias("tiers")
    )


@query
def ledger_counts(t: TestLedger) -> DataFrame:
    relevant = events.relevant_only(events.transfers_only(t.unnumbered), t.labels).txs
    return coverage.ledger_counts(t.blocks, relevant, plain_events(t))


@query
def coverage_stats(t: TestLedger) -> DataFrame:
    return coverage.coverage_stats(t.event_blocks)


@query
def block_gaps(t: TestLedger) -> DataFrame:
    return coverage.block_gaps(t.event_blocks)


@query
def period_readiness(t: TestLedger) -> DataFrame:
    return coverage.period_readiness(t.event_blocks)


@query
def block_times(t: TestLedger) -> DataFrame:
    """Scalar functions over every block: distance from the tip and sizes as text."""
    age = F.col("age")
    return t.event_blocks.withColumn("age", periods.tip(t.event_blocks) - F.col("height")).select(
        "height",
        scalars.blocks_to_time(age).alias("age_text"),
        scalars.days_of_blocks(age).alias("age_days"),
        scalars.time_to_blocks(F.col("tx_count") * F.lit(1.5)).alias("blocks_of_hours"),
        scalars.format_bytes(F.col("tx_count") * age * age).alias("size_text"),
    )


# ------------------------------------------------------------------ attribution


def probes(t: TestLedger, *sides: str, store: bool = False) -> DataFrame:
    """Side, wallet, height and time of all open events of the sides."""
    open_events = attribution.attribution_candidates(plain_events(t), NOW, cap=None)
    found = open_events.filter(F.col("side").isin(*sides)).select("side", "wallet", "height", "block_time").distinct()
    return materialise(found, "probes") if store else found


def evidence(t: TestLedger) -> attribution.Evidence:
    return attribution.Evidence.of(t.ledger, t.operators)


def edges(t: TestLedger, direction: str) -> DataFrame:
    return history.hop_edges(history.wallet_history(t.unnumbered), t.ledger, direction)


@query
def wallet_history(t: TestLedger) -> DataFrame:
    return history.wallet_history(t.unnumbered)


@query
def attribution_candidates(t: TestLedger) -> DataFrame:
    return attribution.attribution_candidates(all_events(t), NOW).drop("event_seq")


@query
def unknown_stats(t: TestLedger) -> DataFrame:
    return attribution.unknown_stats(plain_events(t), NOW)


@query
def coinbase_evidence(t: TestLedger) -> DataFrame:
    receipts = history.coinbase_receipts(history.wallet_history(t.unnumbered))
    return history.coinbase_evidence(probes(t, BUYING, SELLING), receipts)


@query
def historical_connection(t: TestLedger) -> DataFrame:
    t = t.stored()
    return attribution.historical_connection(probes(t, BUYING, SELLING, store=True), evidence(t))


@query
def next_hop(t: TestLedger) -> DataFrame:
    return history.next_hop(probes(t, BUYING), edges(t, SENT))


@query
def next_hop_oldest(t: TestLedger) -> DataFrame:
    return history.next_hop(probes(t, BUYING), edges(t, SENT), order="oldest")


@query
def prev_hop(t: TestLedger) -> DataFrame:
    return history.prev_hop(probes(t, SELLING), edges(t, RECEIVED))


@query
def multi_hop_2(t: TestLedger) -> DataFrame:
    t = t.stored()
    found = attribution.multi_hop(probes(t, BUYING, SELLING, store=True), evidence(t))
    return found.withColumns({"chain": joined("chain"), "txids": joined("txids")})


def overlay(t: TestLedger) -> DataFrame:
    """The overlay of one run over a stored ledger, all that it took deleted."""
    return distilled(lambda: attribution.attribute_unknowns(all_events(t), evidence(t), NOW), "overlay")


def attributed(t: TestLedger) -> DataFrame:
    """The events of a stored ledger, built once, after one run."""
    ev = materialise(all_events(t), "events")
    found = distilled(lambda: attribution.attribute_unknowns(ev, evidence(t), NOW), "overlay")
    return attribution.apply_overlay(ev, found)


def flat_attribution(ev: DataFrame, side: str) -> list[Column]:
    d = F.col(f"{side}_details")
    return [
        d[f].alias(f"{side}_{f}")
        for f in (
            "name", "node_count", "node_wallet", "hop_count", "detection_method", "status",
            "last_coinbase_block", "coinbase_count", "days_inactive", "connection_txid",
            "connection_block", "days_ago", "destination_coinbase_count", "destination_last_coinbase",
        )
    ] + [joined(d["intermediary_txids"]).alias(f"{side}_txids"), tier_text(d["tiers"]).alias(f"{side}_tiers")]


@query
def attributed_events(t: TestLedger) -> DataFrame:
    t = t.stored()
    return flat_attributed(attributed(t))


def flat_attributed(ev: DataFrame) -> DataFrame:
    return ev.select(
        *EVENT_KEY, "block_height", "from_address", "from_type", "to_address", "to_type", "flow_type",
        "classification_level", "intermediary_wallet", joined("hop_chain").alias("hop_chain"),
        "analysis_timestamp", "data_source", *flat_attribution(ev, "from"), *flat_attribution(ev, "to"),
    )


# The first height of a week; the chain's newer part comes an hour after the first run.
NEWER = 1389 * BUCKET_BLOCKS


@query
def attribution_cycle_stored(t: TestLedger) -> DataFrame:
    """Three stored runs: over the older events, an hour later with the newer ones, and once the
    older ones' cool-down is over. Each finds only what is due."""
    t = t.stored()
    base, proof = landing(t), evidence(t)
    kept = attempts.AttributedEvents(t.spark, f"{base}/events", f"{base}/attempts")
    found = materialise(events.senders(events.transfers_only(t.ledger), t.labels), "senders")  # both parts read it
    for run, part in ((NOW, F.col("height") < NEWER), (NOW + 3_600, F.col("height") >= NEWER), (NOW + 88_000, None)):
        if part is not None:
            ev = events.build_flow_events(t.ledger.filter(part), t.labels, found)
            tables.write_buckets(ev.withColumn("height_bucket", coverage.height_bucket(F.col("block_height"))), kept.events_path, "block_height")
        kept.cycle(proof, run)
    return flat_attributed(kept.events())


@query
def attribution_stats(t: TestLedger) -> DataFrame:
    t = t.stored()
    return attribution.attribution_stats(attributed(t))


@query
def attribution_report_maintained(t: TestLedger) -> DataFrame:
    """The report out of maintained tables that three batches of transactions built, one of them twice."""
    t = t.stored()
    kept = adjacency.Adjacency.of(t.spark, f"ledger_{uuid.uuid4().hex}", t.operators, buckets=8)
    part = F.pmod(F.xxhash64("txid"), F.lit(3))
    for batch in (0, 1, 2, 1):
        kept.extend(t.ledger.filter(part == batch), f"b{batch}")
    return attribution.attribution_report(attribution.attribute_unknowns(all_events(t), kept, NOW))


@query
def attribution_report(t: TestLedger) -> DataFrame:
    return attribution.attribution_report(overlay(t.stored()))


# ------------------------------------------------------------------ tables


@query
def upsert_dedupe(t: TestLedger) -> DataFrame:
    """Lines arrive twice, keyed by order and line number; the last version stays."""
    lines = t.table("lineitem").select("l_orderkey", *LINE_ORDER)
    keys = ["l_orderkey", "l_linenumber"]
    merged = tables.upsert(lines, lines, keys, [c for c in LINE_ORDER if c not in keys])
    return merged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query
def retain_6m(t: TestLedger) -> DataFrame:
    kept = tables.retain(t.ledger.txs, periods.tip(t.blocks), SIX_MONTHS, "height")
    return kept.select("txid", "height")


@query
def retention_report(t: TestLedger) -> DataFrame:
    led = events.transfers_only(t.unnumbered)
    txs = events.tx_totals(events.relevant_only(led, t.labels))
    return tables.retention_report(t.blocks, txs, plain_events(t), periods.tip(t.blocks))


@query
def retention_applied(t: TestLedger) -> DataFrame:
    """Store blocks, transactions and events, delete what six months leave behind, count again."""
    base = landing(t)
    led = events.transfers_only(t.unnumbered)
    found = materialise(events.senders(led, t.labels), "senders")  # transactions and events read it
    stored = {
        "blocks": (t.blocks, "height"),
        "transactions": (events.tx_totals(events.relevant_only(led, t.labels, found)), "block_height"),
        "flow_events": (events.build_flow_events(t.unnumbered, t.labels, found), "block_height"),
    }
    for name, (df, height) in stored.items():
        tables.write_buckets(df.withColumn("height_bucket", coverage.height_bucket(F.col(height))), f"{base}/{name}", height)
    places = {name: (f"{base}/{name}", height) for name, (_, height) in stored.items()}
    tip = t.spark.read.parquet(f"{base}/blocks").agg(F.max("height")).first()[0]
    report = tables.apply_retention(t.spark, places, tip)
    left = [t.spark.read.parquet(path).select(F.lit(name).alias("part"), F.col(height).alias("h")) for name, (path, height) in places.items()]
    left = reduce(DataFrame.unionByName, left).groupBy("part").agg(F.count("*").alias("rows_left"), F.min("h").alias("lowest"))
    return report.join(left, "part", "left")


@query
def retention_due(t: TestLedger) -> DataFrame:
    return tables.retention_due(t.blocks)


# ------------------------------------------------------------------ views


@query
def event_detail_view(t: TestLedger) -> DataFrame:
    return _view(all_events(t), views.event_detail_view)


def _view(ev: DataFrame, view: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    ev = materialise(ev, "events")  # both sides read it
    return view(ev, BUYING).withColumn("side", F.lit(BUYING)).unionByName(
        view(ev, SELLING).withColumn("side", F.lit(SELLING))
    )


@query
def attribution_view(t: TestLedger) -> DataFrame:
    t = t.stored()
    return _view(attributed(t), views.attribution_view).withColumn("hop_chain", joined("hop_chain"))


# ------------------------------------------------------------------ transaction view


def classified(t: TestLedger, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    led = events.transfers_only(t.ledger if numbered else t.unnumbered)
    return txview.classify_transactions(led, t.labels), txview.explode_classifications(led, t.labels)


@query
def classify_transactions(t: TestLedger) -> DataFrame:
    return classified(t)[0].drop("satoshi")


@query
def explode_classifications(t: TestLedger) -> DataFrame:
    return classified(t, numbered=True)[1].select(
        "txid", "direction", "pos", "address", "type", F.col("details.name").alias("name"),
        F.col("details.node_count").alias("nodes"),
    )


@query
def tx_with_parties(t: TestLedger) -> DataFrame:
    return txview.tx_with_parties(*classified(t, numbered=True)).select(
        "txid", "block_height", "flow_type", "total_value", "direction", "pos", "address", "type"
    )


@query
def tx_flow_summary(t: TestLedger) -> DataFrame:
    return txview.tx_flow_summary(classified(t)[0])


@query
def buying_transactions(t: TestLedger) -> DataFrame:
    return txview.buying_transactions(classified(t)[0]).select("txid", "block_height", "total_value")


@query
def selling_transactions(t: TestLedger) -> DataFrame:
    return txview.selling_transactions(classified(t)[0]).select("txid", "block_height", "total_value")


@query
def tx_between(t: TestLedger) -> DataFrame:
    return scans.tx_between(classified(t)[0], 28_000_000, 29_000_000).drop("satoshi", "flow_direction")


@query
def lookup_transaction(t: TestLedger) -> DataFrame:
    return scans.lookup(classified(t)[0], txid="T7").select("txid", "block_height", "total_value", "flow_type")


@query
def latest_block(t: TestLedger) -> DataFrame:
    return scans.latest_block(t.blocks)


@query
def tx_by_flow_type(t: TestLedger) -> DataFrame:
    return scans.tx_by_flow_type(classified(t)[0], "transfer").select("txid", "block_time", "total_value")


@query
def tx_top_buyers(t: TestLedger) -> DataFrame:
    return txview.tx_top_buyers(*classified(t))


@query
def tx_top_sellers(t: TestLedger) -> DataFrame:
    return txview.tx_top_sellers(*classified(t))


@query
def exchange_activity(t: TestLedger) -> DataFrame:
    return txview.exchange_activity(*classified(t))


@query
def classification_counts(t: TestLedger) -> DataFrame:
    return txview.classification_counts(classified(t)[1])


@query
def tx_view_stats(t: TestLedger) -> DataFrame:
    return txview.tx_view_stats(t.blocks, *classified(t))


# ------------------------------------------------------------------ files and streams


def landing(t: TestLedger) -> str:
    """A new folder in the cluster's shared space."""
    return f"{shared_dir(t.spark)}/landing-{uuid.uuid4().hex}"


def land(lines: DataFrame, path: str) -> None:
    """Add JSON lines to a folder, in gzip as files come from far."""
    with shuffles_dropped(lines.sparkSession):
        lines.write.mode("append").json(path, compression="gzip")


def land_transactions(t: TestLedger, path: str) -> None:
    """Write the ledger as landed transaction lines, every third in the second dialect."""
    second = F.col("tx_index") % 3 == 0
    land(chain.landed_transactions(t.ledger, second), path)


# Addresses or nodes per landed document.
DOCUMENT = 1000


@query
def labels_from_files(t: TestLedger) -> DataFrame:
    """Land the labels as configuration documents of bounded size and read them back."""
    path = landing(t)
    numbered = t.listed.selectExpr("*", f"CAST(substring(address, 2) AS BIGINT) div {DOCUMENT} AS doc")
    lists = numbered.groupBy("doc", "type", "name").agg(F.expr("collect_list(address) AS addresses"))
    documents = lists.groupBy("doc").agg(
        F.expr("collect_list(struct(name, addresses)) FILTER (WHERE type = 'exchange') AS exchanges"),
        F.expr("any_value(struct(name, addresses)) FILTER (WHERE type = 'foundation') AS foundation"),
    )
    documents.drop("doc").write.json(path)
    return read_labels(t.spark, path, lines=True).select("address", "type", "name")


@query
def registry_from_files(t: TestLedger) -> DataFrame:
    """Land the node registry as documents of both shapes and count it again."""
    path = landing(t)
    numbered = t.nodes.selectExpr("*", f"CAST(substring(payment_address, 2) AS BIGINT) div {DOCUMENT} AS doc")
    documents = numbered.groupBy("doc").agg(
        F.expr("collect_list(struct(payment_address, tier, collateral)) AS nodes")
    )
    # Every other document is an object with a count beside the list.
    documents.selectExpr(
        "if(doc % 2 = 0, to_json(nodes), to_json(struct(size(nodes) AS totalNodes, nodes)))"
    ).write.text(path)
    return labels.node_operators(read_node_registry(t.spark, path, lines=True)).select(
        "address", "node_count", tier_text(F.col("tiers")).alias("tiers"), "total_collateral"
    )


@query
def blocks_from_files(t: TestLedger) -> DataFrame:
    """Land blocks, those of even height with their transactions inside, the others with a list of
    ids and kinds beside transactions landed apart, and read the outputs of both."""
    base = landing(t)
    txs = chain.landed_transactions(t.ledger, F.col("tx_index") % 3 == 0).withColumn("inside", F.col("blockHeight") % 2 == 0)
    payload = F.struct("txid", "vin", "vout", "inputs", "outputs")
    # In every fifth block the kinds come in another order than the transactions.
    order = F.when(F.col("blockHeight") % 5 == 0, -F.col("txIndex")).otherwise(F.col("txIndex"))
    # Only payloads that a block carries travel to it.
    carried = F.when(F.col("inside"), F.struct("txIndex", payload.alias("tx")))
    per_block = txs.groupBy(F.col("blockHeight").alias("height"), F.col("blockTime").alias("time"), "inside").agg(
        F.transform(F.array_sort(F.collect_list(carried)), lambda x: x["tx"]).alias("txs"),
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), "txid", "kind"))), lambda x: F.struct(x["txid"].alias("txid"), x["kind"].alias("kind"))).alias("txDetails"),
    )
    per_block.select("height", "time", F.when(F.col("inside"), F.col("txs")).alias("txs"), "txDetails").write.json(f"{base}/blocks")
    txs.filter(~F.col("inside")).drop("inside", "blockHeight", "blockTime", "txIndex", "kind").write.json(f"{base}/txs")
    raw = chain.read_raw_blocks(t.spark, f"{base}/blocks")
    listed = chain.listed_transactions(raw.filter("txs IS NULL"), chain.read_raw_transactions(t.spark, f"{base}/txs"))
    found = chain.inline_transactions(raw).unionByName(listed)
    return chain.normalize_ledger(found).outputs.select("txid", "kind", "height", "vout", "address", scalars.coins(F.col("satoshi")).alias("value"))


@query
def details_round_trip(t: TestLedger) -> DataFrame:
    """The details of all events written as JSON text and parsed again."""
    text = all_events(t).select(*EVENT_KEY, details_to_json(F.col("from_details")).alias("from_json"), details_to_json(F.col("to_details")).alias("to_json"))
    back = text.select(*EVENT_KEY, details_from_json(F.col("from_json")).alias("f"), details_from_json(F.col("to_json")).alias("t"))
    return back.select(*EVENT_KEY, F.col("f.name").alias("from_name"), F.col("f.node_count").alias("from_nodes"), F.col("t.name").alias("to_name"), F.col("t.node_count").alias("to_nodes"))


@query
def json_round_trip(t: TestLedger) -> DataFrame:
    path = landing(t)
    land_transactions(t, path)
    led = chain.normalize_ledger(chain.read_raw_transactions(t.spark, path))
    return led.outputs.select("txid", "kind", "height", "vout", "address", scalars.coins(F.col("satoshi")).alias("value"))


@query
def stream_ingest(t: TestLedger) -> DataFrame:
    """Land the ledger as files, follow them to the end, read the stored events."""
    base = landing(t)
    land_transactions(t, f"{base}/in")
    stream = ingest.stream_ingest(
        t.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint",
        labels=lambda: t.labels, trigger={"availableNow": True},
    )
    stream.awaitTermination()
    return flat_events(ingest.stored_events(t.spark, f"{base}/out"))


@query
def stream_tip_and_backfill(t: TestLedger) -> DataFrame:
    """Two streams with checkpoints of their own, one after the other, into one sink."""
    base = landing(t)
    middle = t.ledger.txs.agg(F.expr("percentile_approx(height, 0.5)")).scalar()
    second = F.col("tx_index") % 3 == 0
    for name, part in (("tip", F.col("height") > middle), ("back", F.col("height") <= middle)):
        land(chain.landed_transactions(t.ledger.filter(part), second), f"{base}/{name}")
        ingest.stream_ingest(
            t.spark, f"{base}/{name}", f"{base}/out", f"{base}/checkpoint-{name}",
            labels=lambda: t.labels, trigger={"availableNow": True},
        ).awaitTermination()
    return flat_events(ingest.stored_events(t.spark, f"{base}/out"))


@query
def upsert_moved_key(t: TestLedger) -> DataFrame:
    """Every third transaction is first stored three weeks higher, then comes again where it belongs."""
    base = landing(t)
    real = t.ledger.txs.select("txid", "height")
    first = real.withColumn("height", F.expr("height + if(xxhash64(txid) % 3 = 0, 60480, 0)"))
    for n, batch in enumerate((first, real)):
        tables.merge_into(
            f"{base}/t", batch, lambda old, new: tables.upsert(old, new, ["txid"], ["height"]), "height", f"{base}/s{n}", ["txid"]
        )
    return t.spark.read.parquet(f"{base}/t").select("txid", "height")


@query
def stream_flow_totals(t: TestLedger) -> DataFrame:
    """Land the events as files, follow them to the end, read the running totals."""
    base = landing(t)
    all_events(t).write.parquet(f"{base}/events")
    stream = totals.stream_flow_totals(
        t.spark, f"{base}/events", f"{base}/totals", f"{base}/checkpoint", trigger={"availableNow": True}
    )
    stream.awaitTermination()
    return t.spark.read.parquet(f"{base}/totals").select(
        "flow_type", "height_bucket", scalars.coins(F.col("satoshi")).alias("total"), "events"
    )


@query
def stream_totals_maintained(t: TestLedger) -> DataFrame:
    """Totals that ingest keeps: every third transaction first comes with twice its amounts and
    three weeks higher, then as it is; each counts once."""
    base = landing(t)
    second = F.col("tx_index") % 3 == 0
    wrong = F.xxhash64("txid") % 3 == 0

    def early(df: DataFrame) -> DataFrame:
        changed = df.withColumn("height", F.expr("height + if(xxhash64(txid) % 3 = 0, 60480, 0)"))
        return changed.withColumn("satoshi", F.when(wrong, F.col("satoshi") * 2).otherwise(F.col("satoshi")).cast(df.schema["satoshi"].dataType)) if "satoshi" in df.columns else changed

    first = Ledger(early(t.ledger.txs), early(t.ledger.inputs), early(t.ledger.outputs))
    for name, led in (("first", first), ("then", t.ledger.filter(wrong))):
        land(chain.landed_transactions(led, second), f"{base}/{name}")
        ingest.stream_ingest(
            t.spark, f"{base}/{name}", f"{base}/out", f"{base}/checkpoint-{name}",
            labels=lambda: t.labels, trigger={"availableNow": True},
        ).awaitTermination()
    return totals.maintained_totals(t.spark, f"{base}/out").select(
        "flow_type", "height_bucket", scalars.coins(F.col("satoshi")).alias("total"), "events"
    )


@query
def stream_registry_refresh(t: TestLedger) -> DataFrame:
    """One stream over two versions of the registry: even transactions arrive while operators have one
    node each and some are not known yet, odd ones when some have left; each keeps what it met."""
    base = landing(t)
    registry = Registry(t.spark, f"{base}/registry")
    number = F.substring("payment_address", 2, 20).cast("bigint")
    versions = (t.nodes.filter(number % 4 != 1).distinct(), t.nodes.filter(number % 7 != 0))
    for at, nodes in enumerate(versions):
        registry.refresh(labels.node_operators(nodes), 10 * at + 1)
        registry.refresh(labels.node_operators(t.nodes.filter("false")), 10 * at + 2)  # brings none
        part = t.ledger.filter(F.col("tx_index") % 2 == at)
        land(chain.landed_transactions(part, F.col("tx_index") % 3 == 0), f"{base}/in")
        ingest.stream_ingest(
            t.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint",
            labels=BatchLabels(registry, lambda: t.listed), trigger={"availableNow": True},
        ).awaitTermination()
    return flat_events(ingest.stored_events(t.spark, f"{base}/out"))


@query
def relevance_from_ingest(t: TestLedger) -> DataFrame:
    """Follow blocks that name more transactions than they carry, every fourth none at all: relevance
    per block, and over the batches together."""
    base = landing(t)
    txs = chain.landed_transactions(t.ledger, F.col("tx_index") % 3 == 0)
    payload = F.struct("txid", "vin", "vout", "inputs", "outputs")
    carried = txs.groupBy(F.col("blockHeight").alias("height")).agg(
        F.min("blockTime").alias("time"),
        F.array_sort(F.collect_list(F.struct("txIndex", "txid", "kind", payload.alias("tx")))).alias("c"),
    )
    named = F.when(F.col("height") % 4 != 0, F.size("c") + F.col("height") % 3)
    lines = carried.select(
        "height", "time", named.cast("int").alias("txCount"), F.transform("c", lambda x: x["tx"]).alias("txs"),
        F.transform("c", lambda x: F.struct(x["txid"].alias("txid"), x["kind"].alias("kind"))).alias("txDetails"),
    )
    land(lines.repartition(6, "height"), f"{base}/in")
    ingest.stream_blocks(
        t.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint",
        labels=lambda: t.labels, max_files=4, trigger={"availableNow": True},
    ).awaitTermination()
    per_block = relevance.block_relevance(t.spark, f"{base}/out", t.spark.read.parquet(f"{base}/out/blocks"))
    together = relevance.batch_relevance(t.spark, f"{base}/out").agg(
        F.lit("batches").alias("part"), F.lit(None).cast("bigint").alias("height"),
        F.sum("relevant").alias("relevant"), F.sum("total").alias("total"),
    )
    return per_block.withColumn("part", F.lit("block")).unionByName(events.share(together))

"""Labels, relevance, primary inputs, flow types."""

import re

from ledgerflow.operators.events import (
    build_flow_events,
    cap_per_block,
    relevance_rate,
    relevant_only,
    senders,
    tx_totals,
)
from ledgerflow.operators.labels import classify_addresses, label_dimension, label_stats, node_operators
from tests.chain import labels, ledger, nodes, rows


def test_single_address_precedence(spark):
    lab = labels(spark, exchanges=["E"], foundation=["E", "F"], operators=["E", "F", "N"])
    asked = spark.createDataFrame([("E",), ("F",), ("N",), ("X",)], "a STRING")
    assert rows(classify_addresses(asked, "a", lab), "a", "type") == [
        ("E", "exchange"), ("F", "foundation"), ("N", "node_operator"), ("X", "unknown"),
    ]


def test_details_have_only_the_fields_of_their_type(spark):
    lab = labels(spark, exchanges=["E"], foundation=["F"], operators=["N", "N"])
    assert rows(lab, "address", "details.name", "details.logo", "details.node_count") == [
        ("E", "name-E", "logo-E", None), ("F", "Foundation", None, None), ("N", None, None, 2),
    ]


def test_later_exchange_wins_a_shared_address(spark):
    both = spark.createDataFrame(
        [("A", "exchange", "one", None, 0), ("A", "exchange", "two", None, 1)],
        "address STRING, type STRING, name STRING, logo STRING, position BIGINT",
    )
    lab = label_dimension(both, node_operators(nodes(spark)))
    assert rows(lab, "details.name") == [("two",)]


def test_operator_beats_foundation_among_inputs(spark):
    led = ledger(spark, ("t", 1, ["F", "N"], ["x"]))
    got = senders(led, labels(spark, foundation=["F"], operators=["N"]))
    assert rows(got, "from_address", "from_type") == [("N", "node_operator")]


def test_address_that_is_both_counts_as_foundation(spark):
    led = ledger(spark, ("t", 1, ["B"], ["x"]))
    got = senders(led, labels(spark, foundation=["B"], operators=["B"]))
    assert rows(got, "from_type") == [("foundation",)]


def test_only_first_addresses_make_a_transaction_relevant(spark):
    lab = labels(spark, exchanges=["E"])
    led = ledger(spark, ("second", 1, [["u", "E"]], ["x"]), ("first", 1, [["E", "u"]], ["x"]))
    assert rows(relevant_only(led, lab).txs, "txid") == [("first",)]
    # A relevant transaction may still get its sender from a second address.
    led = ledger(spark, ("t", 1, [["u", "E"]], ["E", "x"]))
    assert rows(senders(led, lab), "from_address", "from_type") == [("E", "exchange")]


def test_change_is_p2p(spark):
    led = ledger(spark, ("t", 1, ["E"], ["x", "E"]), ("s", 1, ["x"], ["E", "x"]))
    ev = build_flow_events(led, labels(spark, exchanges=["E"]))
    assert rows(ev, "txid", "vout", "flow_type") == [
        ("s", 0, "selling"), ("s", 1, "p2p"), ("t", 0, "buying"), ("t", 1, "p2p"),
    ]


def test_outputs_without_address_keep_their_number(spark):
    led = ledger(spark, ("t", 1, ["E"], ["x", [], "y"]))
    ev = build_flow_events(led, labels(spark, exchanges=["E"]))
    assert rows(ev, "vout", "to_address", "amount") == [(0, "x", 1.0), (2, "y", 3.0)]


def test_transaction_without_inputs_is_from_unknown(spark):
    led = ledger(spark, ("t", 1, [], ["E"]), ("u", 1, [[]], ["E"]))
    ev = build_flow_events(led, labels(spark, exchanges=["E"]))
    assert rows(ev, "txid", "from_address", "from_type", "flow_type") == [
        ("t", "unknown", "unknown", "selling"), ("u", "unknown", "unknown", "selling"),
    ]


def test_coinbase_and_confirmations_yield_no_events(spark):
    led = ledger(spark, ("c", 1, [], ["E"], "coinbase"), ("f", 1, ["E"], ["x"], "confirm"))
    assert build_flow_events(led, labels(spark, exchanges=["E"])).count() == 0


def test_cap_keeps_the_first_transfers_of_a_block(spark):
    led = ledger(spark, ("c", 1, [], ["x"], "coinbase"), *[(f"t{i}", 1, ["x"], ["y"]) for i in range(4)])
    capped = cap_per_block(led, 2)
    assert rows(capped.txs, "txid") == [("t0",), ("t1",)]
    assert capped.outputs.count() == 2
    assert cap_per_block(led).txs.count() == 4


def test_registry_defaults(spark):
    raw = [("a", None, "1000"), ("a", "", "12.5x"), ("a", "STRATUS", "abc"), ("a", "NOVA", None), ("", "NIMBUS", "1"), (None, "NIMBUS", "1")]
    got = node_operators(spark.createDataFrame(raw, "payment_address STRING, tier STRING, collateral STRING"))
    row = got.collect()
    assert len(row) == 1 and row[0].address == "a" and row[0].node_count == 4
    assert row[0].tiers == {"CUMULUS": 2, "NIMBUS": 0, "STRATUS": 1, "NOVA": 1}
    assert row[0].total_collateral == 1012.5


def test_exchange_count_counts_addresses(spark):
    lab = spark.createDataFrame(
        [("A", "exchange", "one", None, 0), ("B", "exchange", "one", None, 0), ("F", "foundation", "f", None, 0)],
        "address STRING, type STRING, name STRING, logo STRING, position BIGINT",
    )
    got = label_stats(lab, node_operators(nodes(spark, "n", "n", "m"))).first()
    assert (got.exchange_count, got.exchange_names, got.foundation_count) == (2, "one", 1)
    assert (got.operator_count, got.total_nodes, got.cumulus_nodes) == (2, 3, 3)


def test_totals_and_relevance_rate(spark):
    led = ledger(spark, ("t", 1, ["E", ["a", "b"]], ["x", []]), ("u", 1, ["q"], ["r"]), ("v", 2, [], []))
    assert rows(tx_totals(led), "txid", "input_count", "output_count", "total_input_value", "total_output_value") == [
        ("t", 2, 2, 3.0, 3.0), ("u", 1, 1, 1.0, 1.0), ("v", 0, 0, 0.0, 0.0),
    ]
    rate = relevance_rate(led, labels(spark, exchanges=["E"]))
    assert rows(rate, "height", "relevant", "total", "rate") == [(1, 1, 2, 0.5), (2, 0, 1, 0.0)]




def test_outputs_meet_their_sender_before_their_receiver(spark):
    led = ledger(spark, ("t", 1, ["E"], ["x", "E"]), ("u", 2, ["x"], ["y"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ev = build_flow_events(led, labels(spark, exchanges=["E"]))
        assert rows(ev, "txid", "to_address", "to_type") == [("t", "E", "exchange"), ("t", "x", "unknown")]
        shuffles = re.findall(r"Exchange hashpartitioning\((\w+)#", ev._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The last shuffle of the outputs looks receivers up; none brings them back to their transaction.
    assert shuffles[0] == "to_address"

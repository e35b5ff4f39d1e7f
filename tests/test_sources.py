"""Raw files, scalar functions, streams."""

import json

from pyspark.sql import functions as F

from ledgerflow.functions import scalars
from ledgerflow.operators import txview, views
from ledgerflow.operators.events import build_flow_events
from ledgerflow.operators.labels import label_dimension, node_operators
from ledgerflow.schemas import chain_from_json, details_from_json, details_to_json
from ledgerflow.sources import chain
from ledgerflow.sources.labels import read_labels, read_node_registry, refreshed_operators
from ledgerflow.streaming import ingest, totals
from tests.chain import labels, ledger, nodes, rows


def lines(path, *items):
    path.write_text("\n".join(json.dumps(i) for i in items))
    return str(path)


A = {"vin": [{"addresses": ["E"], "value": "200000000"}],
     "vout": [{"n": 0, "value": 150000000, "scriptPubKey": {"addresses": ["x"]}}, {"value": "0.5x", "addresses": []}]}
B = {"inputs": [{"address": "E", "value": 200000000}],
     "outputs": [{"addresses": ["x"], "value": 0, "valueSat": "150000000"}, {"value": 0}]}


def test_both_dialects_give_the_same_rows(spark, tmp_path):
    path = lines(tmp_path / "t.json", {"txid": "a", "blockHeight": 1, **A}, {"txid": "b", "blockHeight": 1, **B})
    led = chain.normalize_ledger(chain.read_raw_transactions(spark, path))
    side = ["pos", "addr_pos", "address", "satoshi"]
    for txid in "ab":
        assert rows(led.inputs.filter(F.col("txid") == txid), *side) == [(0, 0, "E", 200000000)]
        got = rows(led.outputs.filter(F.col("txid") == txid), "vout", "addr_pos", "address", "satoshi")
        assert got[0] == (0, 0, "x", 150000000) and got[1][:3] == (1, 0, None)


def test_block_counts_and_kinds(spark, tmp_path):
    path = lines(
        tmp_path / "b.json",
        {"height": 1, "time": 30, "txCount": 0, "tx_count": 7, "size": 0},
        {"height": 2, "time": 60, "tx": ["a", "b"], "size": 10, "txDetails": [{"txid": "a", "kind": "coinbase"}, {"txid": "b", "kind": "transfer"}]},
        {"height": 3, "time": 90, "txs": [{"txid": "c", **A}]},
        {"height": 4, "time": 120},
    )
    raw = chain.read_raw_blocks(spark, path)
    assert rows(chain.block_table(raw), "height", "tx_count", "size") == [(1, 7, None), (2, 2, 10), (3, 1, None), (4, 0, None)]
    inline = chain.inline_transactions(raw)
    assert rows(inline, "txid", "blockHeight", "kind") == [("c", 3, None)]
    txs = chain.read_raw_transactions(spark, lines(tmp_path / "t.json", {"txid": "a", **A}, {"txid": "b", **B}))
    assert rows(chain.listed_transactions(raw, txs), "txid", "blockHeight", "txIndex") == [("b", 2, 1)]


def test_label_file_and_registry_shapes(spark, tmp_path):
    config = {"exchanges": [{"name": "one", "addresses": ["A", "B"], "logo": "l1"}, {"name": "two", "addresses": ["B"], "logo": "l2"}],
              "foundation": {"name": "Fund", "addresses": ["F"], "logo": "lf"}}
    (tmp_path / "labels.json").write_text(json.dumps(config, indent=1))
    lab = label_dimension(read_labels(spark, str(tmp_path / "labels.json")), node_operators(nodes(spark)))
    assert rows(lab, "address", "details.name", "details.logo") == [("A", "one", "l1"), ("B", "two", "l2"), ("F", "Fund", None)]
    registry = [{"payment_address": "n", "tier": "NIMBUS", "collateral": 12500}]
    documents = {
        "a": registry, "b": {"status": "ok", "someNodes": registry}, "c": {"nodes": registry}, "d": {"x": 1},
        "e": {"totalNodes": 2, "someNodes": registry}, "f": {"someNodes": 3, "nodes": registry}, "g": {"otherNodes": registry},
    }
    for name, document in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
        found = read_node_registry(spark, str(tmp_path / f"{name}.json"), keys=["someNodes", "nodes"])
        assert rows(found, "payment_address", "tier", "collateral") == ([] if name in "dg" else [("n", "NIMBUS", "12500")])
    old, new, none = (node_operators(nodes(spark, *a)) for a in (["o"], ["p"], []))
    assert rows(refreshed_operators(old, new), "address") == [("p",)]
    assert rows(refreshed_operators(old, none), "address") == [("o",)]


def test_scalar_functions(spark):
    one = spark.range(1)
    text = lambda c: one.select(c.alias("v")).first().v
    assert text(scalars.blocks_to_time(F.lit(2880 * 3 + 125))) == "3d 1h"
    assert text(scalars.blocks_to_time(F.lit(125))) == "1h 2m"
    assert text(scalars.blocks_to_time(F.lit(5))) == "2m"
    assert text(scalars.time_to_blocks(F.lit(24))) == 2880
    assert text(scalars.format_bytes(F.lit(1536))) == "1.50 KB"
    assert text(scalars.format_bytes(F.lit(12))) == "12 B"
    assert text(scalars.shorten(F.lit("abcdefghijklmnop"))) == "abcdefgh...klmnop"
    assert text(scalars.shorten(F.lit(None).cast("string"))) == ""
    assert text(scalars.satoshi(F.lit(" 12abc"))) == 12
    assert text(scalars.satoshi(F.lit("abc"))) is None and text(scalars.satoshi_or_zero(F.lit("abc"))) == 0
    assert text(scalars.party_label(F.lit("node"))) == "Node Operator"
    assert text(scalars.party_label(F.lit("other"))) == "other"


def test_details_json_round_trip(spark):
    lab = labels(spark, exchanges=["E"], operators=["N"])
    again = lab.select("address", details_from_json(details_to_json("details")).alias("details"))
    assert sorted(again.collect(), key=str) == sorted(lab.select("address", "details").collect(), key=str)
    texts = spark.createDataFrame([('["a","b"]',), ("junk",), (None,)], "c STRING")
    assert [r.v for r in texts.select(chain_from_json(F.col("c")).alias("v")).collect()] == [["a", "b"], None, None]


def test_transaction_view(spark):
    lab = labels(spark, exchanges=["E", "G"], operators=["N"])
    led = ledger(spark, ("buy", 1, ["E"], ["x", "x"]), ("sell", 2, ["N"], ["E"]), ("move", 3, ["E"], ["G"]), ("none", 4, ["x"], ["y"]))
    tx, parties = txview.classify_transactions(led, lab), txview.explode_classifications(led, lab)
    assert rows(tx, "txid", "flow_type", "flow_direction") == [
        ("buy", "buy", "from_exchange"), ("move", "transfer", "exchange_to_exchange"),
        ("none", None, None), ("sell", "sell", "to_exchange"),
    ]
    # Two outputs to one address count the whole value twice.
    assert rows(txview.tx_top_buyers(tx, parties), "address", "transaction_count", "total_bought") == [("x", 1, 6.0)]
    assert rows(txview.tx_flow_summary(tx, 2, 9), "flow_type", "tx_count", "total_value") == [
        ("buy", 0, 0.0), ("sell", 1, 1.0), ("transfer", 1, 1.0),
    ]
    activity = txview.exchange_activity(tx, parties)
    assert rows(activity, "exchange_address", "total_inflow", "total_outflow", "sell_transactions", "buy_transactions") == [
        ("E", 1.0, 3.0, 1, 1),
    ]
    assert txview.by_activity(activity).count() == 1
    assert rows(txview.selling_transactions(tx), "txid") == [("sell",)]
    assert txview.tx_with_parties(tx, parties).count() == 7


def test_views(spark):
    ev = build_flow_events(ledger(spark, ("t" * 20, 1, ["E"], ["x", "N"])), labels(spark, exchanges=["E"], operators=["N"]))
    got = views.event_detail_view(ev, "buying")
    assert rows(got, "vout", "exchange", "logo", "wallet_label", "node_count", "cumulus") == [
        (0, "name-E", "/logos/name-e.png", "Unknown Wallet", 0, 0), (1, "name-E", "/logos/name-e.png", "Node Operator", 1, 1),
    ]
    assert rows(views.attribution_view(ev, "buying"), "hierarchy", "badge", "method", "status") == [
        ("direct", None, "current_api", "active"), ("direct", None, "current_api", "active"),
    ]


def test_two_streams_and_a_new_checkpoint_share_a_sink(spark, tmp_path):
    lab = labels(spark, exchanges=["E"], operators=["N"])
    out = str(tmp_path / "out")

    def follow(name, checkpoint):
        ingest.stream_blocks(
            spark, str(tmp_path / name), out, str(tmp_path / checkpoint), lambda: lab, trigger={"availableNow": True}
        ).awaitTermination()

    for name, h in (("tip", 50_000), ("back", 100)):
        (tmp_path / name).mkdir()
        lines(tmp_path / name / "0.json", {"height": h, "time": h * 30, "hash": str(h), "txs": [{"txid": f"t{h}", **A}]})
        follow(name, f"cp-{name}")
    assert rows(ingest.stored_events(spark, out), "block_height") == [(100,), (50_000,)]
    (tmp_path / "tip" / "0.json").unlink()
    lines(tmp_path / "tip" / "1.json", {"height": 50_001, "time": 1_500_030, "hash": "n", "txs": [{"txid": "n", **A}]})
    follow("tip", "cp-new")  # begins again at batch 0
    assert rows(ingest.stored_events(spark, out), "block_height") == [(100,), (50_000,), (50_001,)]


def test_streams_in_any_order_equal_the_batch(spark, tmp_path):
    lab = labels(spark, exchanges=["E"], operators=["N"])
    landing = tmp_path / "in"
    landing.mkdir()
    blocks = [
        {"height": h, "time": h * 30, "hash": str(h), "txs": [{"txid": f"t{h}", **(A if h % 2 else B)}]} for h in (5, 40_000, 6)
    ]
    for n, block in enumerate([*blocks, blocks[0]]):  # one block arrives twice
        lines(landing / f"{n}.json", block)
    out = str(tmp_path / "out")
    for _ in range(2):  # a second start finds nothing new
        ingest.stream_blocks(
            spark, str(landing), out, str(tmp_path / "cp"), lambda: lab, max_files=2, trigger={"availableNow": True}
        ).awaitTermination()
    stored = ingest.stored_events(spark, out)
    columns = ["txid", "vout", "block_height", "flow_type", "amount"]
    assert rows(stored, *columns) == [(f"t{h}", 0, h, "buying", 1.5) for h in (40_000, 5, 6)]
    assert rows(spark.read.parquet(f"{out}/blocks"), "height", "tx_count") == [(40_000, 1), (5, 1), (6, 1)]
    assert rows(spark.read.parquet(f"{out}/transactions"), "txid", "input_count") == [("t40000", 1), ("t5", 1), ("t6", 1)]

    stored.write.parquet(str(tmp_path / "events"))
    totals.stream_flow_totals(
        spark, str(tmp_path / "events"), str(tmp_path / "totals"), str(tmp_path / "cp2"), trigger={"availableNow": True}
    ).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "totals"))
    assert rows(kept, "flow_type", "height_bucket", "events") == [("buying", 0, 2), ("buying", 1, 1)]
    assert rows(totals.totals_between(kept, 0, 0), "total", "events") == [(3.0, 2)]


def test_no_task_holds_the_state_of_all_totals(spark, tmp_path):
    led = ledger(spark, ("t", 1, ["E"], ["x"]), ("u", 40_000, ["x"], ["E"]))
    build_flow_events(led, labels(spark, exchanges=["E"])).repartition(1).write.parquet(str(tmp_path / "events"))
    stream = totals.stream_flow_totals(
        spark, str(tmp_path / "events"), str(tmp_path / "totals"), str(tmp_path / "cp"), trigger={"availableNow": True}
    )
    stream.awaitTermination()
    tracker, tasks = spark.sparkContext.statusTracker(), []
    for job in tracker.getJobIdsForGroup(str(stream.runId)):
        tasks += [info.numTasks for k in tracker.getJobInfo(job).stageIds if (info := tracker.getStageInfo(k))]
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) in tasks  # one task a partition of the state
    assert len(list((tmp_path / "totals").glob("*.parquet"))) == 1

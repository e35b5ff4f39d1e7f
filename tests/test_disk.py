"""What a long job leaves on the disk, and how often it reads and shuffles."""

import glob
import os
import time

from pyspark.sql import functions as F

from ledgerflow.operators import attribution as at
from ledgerflow.operators import events as ev
from ledgerflow.operators import history as hi
from ledgerflow.operators import tables
from ledgerflow.operators.attempts import AttributedEvents
from ledgerflow.operators.coverage import height_bucket
from ledgerflow.operators.labels import node_operators
from ledgerflow.plans import queries
from ledgerflow.session import distilled, materialise, shared_dir
from ledgerflow.streaming import ingest
from tests.chain import labels, ledger, nodes, rows


def folders(spark, label):
    return glob.glob(f"{shared_dir(spark).removeprefix('file:')}/{label}-*")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_frame_leaves_no_shuffles(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in map(str, manager.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before = shuffles()
    stored = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and stored.count() == 7


def test_intermediates_go_once_the_answer_is_stored(spark):
    def made():
        return materialise(spark.range(5), "distilled-step").filter("id > 2")

    got = distilled(made, "distilled-answer")
    assert rows(got, "id") == [(3,), (4,)]
    assert not folders(spark, "distilled-step") and len(folders(spark, "distilled-answer")) == 1


def test_the_queue_is_read_in_one_pass(spark):
    found = ev.build_flow_events(ledger(spark, ("a", 5, ["E"], ["x"]), ("b", 6, ["y"], ["E"])), labels(spark, exchanges=["E"]))
    found = materialise(found, "queue")
    for df in (at.attribution_candidates(found, 9), at.unknown_stats(found, 9)):
        assert plan(df).count("FileScan") == 1
    assert rows(at.attribution_candidates(found, 9), "side", "txid", "wallet") == [("buying", "a", "x"), ("selling", "b", "y")]
    assert rows(at.unknown_stats(found, 9), "unknown_buys", "unknown_sells", "total_unknowns") == [(1, 1, 2)]


def test_edges_are_ordered_in_one_shuffle_unless_a_wallet_is_busy(spark):
    edges = [("a", h, h * 30, i, f"t{i}", f"x{i}") for i, h in enumerate([5, 9, 9, 40_000, 90_000])] + [("b", 7, 210, 9, "t9", "x9"), ("b", None, 1, 10, "u", "u")]
    edges = materialise(spark.createDataFrame(edges, "wallet STRING, height BIGINT, block_time BIGINT, tx_index BIGINT, txid STRING, next_wallet STRING"), "edges")
    points = [(w, h, h * 30) for w in "abc" for h in (5, 6, 9, 10, 40_000, 40_001, 200_000)] + [(None, 9, 9), ("a", None, 9)]
    asked = hi._asked(spark.createDataFrame(points, "wallet STRING, height BIGINT, block_time BIGINT"))
    fewer = lambda n: rows(hi._met(asked, edges, hi.busy_wallets(edges, n)), "wallet", "height", "edge.txid", "edge.hop_height", "edge.hop_time")
    assert not hi.busy_wallets(edges)[1] and rows(hi.busy_wallets(edges, 2)[0], "wallet") == [("a",)]
    expected = [("a", 6, "t0", 5, 150), ("a", 9, "t0", 5, 150), ("a", 10, "t2", 9, 270), ("a", 40_000, "t2", 9, 270)]
    expected += [("a", 40_001, "t3", 40_000, 1_200_000), ("a", 200_000, "t4", 90_000, 2_700_000)]
    expected += [("b", h, "t9", 7, 210) for h in (9, 10, 40_000, 40_001, 200_000)]
    assert fewer(1_000_000) == fewer(2) == sorted(expected, key=repr)
    stored = materialise(asked, "asked")
    assert plan(hi._met(stored, edges, hi.busy_wallets(edges))).count("Exchange") == 1


def test_later_runs_use_the_edges_of_the_first(spark, tmp_path, monkeypatch):
    led = ledger(spark, ("t1", 100, ["E"], ["a"]), ("t2", 101, ["q"], ["E"]), ("t3", 200, ["a"], ["N"]))
    found = ev.build_flow_events(led, labels(spark, exchanges=["E"], operators=["N"]))
    tables.write_buckets(found.withColumn("height_bucket", height_bucket(F.col("block_height"))), f"{tmp_path}/events", "block_height")
    kept = AttributedEvents(spark, f"{tmp_path}/events", f"{tmp_path}/attempts")
    proof, made, hop_edges = at.Evidence.of(led, node_operators(nodes(spark, "N"))), [], at.hop_edges
    monkeypatch.setattr(at, "hop_edges", lambda *a: made.append(a[-1]) or hop_edges(*a))
    assert [sum(r.events for r in kept.cycle(proof, run).collect()) for run in (1_000_000, 1_100_000)] == [2, 1]
    assert sorted(made) == ["received", "sent"]


def test_a_search_reads_the_level_it_is_at(spark, tmp_path):
    edges = spark.createDataFrame([("a", 5, 150, 0, "t", "x")], "wallet STRING, height BIGINT, block_time BIGINT, tx_index BIGINT, txid STRING, next_wallet STRING")
    hi.hop_index(edges, 2).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert rows(index, "key", "block") == [("0|0|a", 5), ("1|0|a", 0), ("2|0|a", 0), ("3|0|a", 0)]
    asked = hi._asked(spark.createDataFrame([("a", 4, 120)], "wallet STRING, height BIGINT, block_time BIGINT"))
    found = hi.search(asked, index, later=True, anywhere=True)
    assert rows(found, "wallet", "height", "edge.txid") == [("a", 4, "t")]
    text = plan(found)
    assert all(f"StringStartsWith(key,{level}|)" in text for level in range(4))


def test_a_batch_finds_its_senders_once_and_stages_events_once(spark, tmp_path, monkeypatch):
    led = ledger(spark, ("a", 5, ["E"], ["x"]), ("b", 6, ["E"], ["y"]))
    calls, merged, merge = [], {}, ingest.merge_into
    senders = ev.senders
    for module in (ev, ingest):
        monkeypatch.setattr(module, "senders", lambda *a: calls.append(1) or senders(*a), raising=False)

    def watched(path, *a, **given):
        merged[os.path.basename(path)] = given.get("stored", False)
        merge(path, *a, **given)

    monkeypatch.setattr(ingest, "merge_into", watched)
    ingest.save_ledger(led, labels(spark, exchanges=["E"]), str(tmp_path), "one")
    assert len(calls) == 1 and merged == {"transactions": False, "flow_events": True}
    assert rows(ingest.stored_events(spark, str(tmp_path)), "txid", "to_address") == [("a", "x"), ("b", "y")]
    assert not glob.glob(f"{tmp_path}/_stage/*/*")


def test_landed_lines_are_small(spark, tmp_path):
    for n in range(2):
        queries.land(spark.range(n, n + 1), f"{tmp_path}/in")
    assert all(f.endswith(".json.gz") for f in glob.glob(f"{tmp_path}/in/part-*"))
    assert rows(spark.read.schema("id BIGINT").json(f"{tmp_path}/in"), "id") == [(0,), (1,)]

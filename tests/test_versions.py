"""Registry versions that batches are bound to, and relevance from what ingest stores."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators.events import relevance_rate
from ledgerflow.operators.labels import node_operators
from ledgerflow.operators.registry import BatchLabels, Registry
from ledgerflow.sources import chain
from ledgerflow.streaming import ingest, relevance
from tests.chain import labels, ledger, listed, nodes, rows


def known(frame):
    return [(r.address, r.node_count, dict(r.tiers)["CUMULUS"]) for r in frame.orderBy("address").collect()]


@pytest.mark.parametrize("full_every", [2, 144])
def test_versions_are_read_as_of(spark, tmp_path, full_every):
    registry = Registry(spark, str(tmp_path), full_every)
    lists = {3: ["M", "N"], 5: ["K", "N", "N"], 9: ["K", "M", "N", "N"], 11: ["K"]}
    assert known(registry.as_of(100)) == []
    for version, operators in lists.items():
        assert registry.refresh(node_operators(nodes(spark, *operators)), version)
    counts = lambda names: [(a, names.count(a), names.count(a)) for a in sorted(set(names))]
    for version in (2, 3, 8, 9, 12):
        expected = [names for v, names in lists.items() if v <= version]
        assert known(registry.as_of(version)) == (counts(expected[-1]) if expected else [])


def test_only_what_differs_is_stored(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    for version, names in enumerate((["M", "N"], ["M", "N"], ["M", "N", "N"], ["N", "N"]), 1):
        registry.refresh(node_operators(nodes(spark, *names)), version)
    stored = spark.read.parquet(f"{tmp_path}/changes")
    assert rows(stored, "version", "address", "gone") == [(1, "M", False), (1, "N", False), (3, "N", False), (4, "M", True)]


def test_refreshes_that_change_nothing(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    first, other = (node_operators(nodes(spark, a)) for a in "NM")
    assert not registry.refresh(first.filter("false"), 1)
    assert registry.refresh(first, 2)
    assert not registry.refresh(other, 2)  # the same version again
    assert not registry.refresh(first.filter("false"), 3)
    with pytest.raises(ValueError):
        registry.refresh(other, 1)
    assert known(registry.as_of(3)) == [("N", 1, 1)]
    # A refresh that died before its version was listed does not count, and is run again.
    registry._changes(other, 7, False).write.parquet(f"{tmp_path}/changes/version=7")
    assert known(registry.as_of(8)) == [("N", 1, 1)]
    assert registry.refresh(other, 7) and known(registry.as_of(8)) == [("M", 1, 1)]


def test_a_repeated_batch_keeps_the_registry_it_knew(spark, tmp_path):
    registry = Registry(spark, f"{tmp_path}/registry")
    follow = BatchLabels(registry, lambda: listed(spark, exchanges=["E"]))

    def land(*txs):
        chain.landed_transactions(ledger(spark, *txs)).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def run():
        ingest.stream_ingest(
            spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", follow, trigger={"availableNow": True}
        ).awaitTermination()
        return rows(ingest.stored_events(spark, f"{tmp_path}/out"), "txid", "to_address", "to_type")

    registry.refresh(node_operators(nodes(spark, "N")), 1)
    land(("t1", 10, ["E"], ["N"]), ("t2", 10, ["E"], ["M"]))
    before = [("t1", "N", "node_operator"), ("t2", "M", "unknown")]
    assert run() == before
    registry.refresh(node_operators(nodes(spark, "M")), 2)
    for name in ("0", ".0.crc"):  # as if the run had died before it could commit its batch
        (tmp_path / "cp" / "commits" / name).unlink()
    assert run() == before
    land(("t3", 10, ["E"], ["N"]), ("t4", 10, ["E"], ["M"]))
    assert run() == [*before, ("t3", "N", "unknown"), ("t4", "M", "node_operator")]


def test_a_block_counts_as_it_says(spark):
    led = ledger(spark, ("t", 1, ["E"], ["x"]), ("u", 1, ["q"], ["r"]), ("v", 2, ["E"], ["x"]), ("w", 3, ["q"], ["r"]))
    own = spark.createDataFrame([(1, 8), (2, 0), (3, None), (4, 5), (5, 0)], "height BIGINT, tx_count INT")
    rate = relevance_rate(led, labels(spark, exchanges=["E"]), own)
    assert rows(rate, "height", "relevant", "total", "rate") == [
        (1, 1, 8, 0.125), (2, 1, 1, 1.0), (3, 0, 1, 0.0), (4, 0, 5, 0.0), (5, 0, 0, 0.0),
    ]
    assert rows(relevance_rate(led.filter(F.lit(False)), labels(spark, exchanges=["E"])), "height") == []


def test_relevance_of_stored_blocks_and_batches(spark, tmp_path):
    lab = labels(spark, exchanges=["E"])
    sale = {"vin": [{"addresses": ["E"], "value": "100"}], "vout": [{"scriptPubKey": {"addresses": ["x"]}, "value": "100", "n": 0}]}
    other = {"vin": [{"addresses": ["q"], "value": "100"}], "vout": [{"scriptPubKey": {"addresses": ["r"]}, "value": "100", "n": 0}]}
    (tmp_path / "in").mkdir()

    def block(name, height, count, *txs):
        carried = [{"txid": txid, **tx} for txid, tx in txs]
        kinds = [{"txid": txid, "kind": "transfer"} for txid, _ in txs]
        line = {"height": height, "time": height * 30, "hash": name, "txCount": count, "txs": carried, "txDetails": kinds}
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(line))

    def run():
        ingest.stream_blocks(
            spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", lambda: lab, trigger={"availableNow": True}
        ).awaitTermination()
        blocks = spark.read.parquet(f"{tmp_path}/out/blocks")
        return rows(relevance.block_relevance(spark, f"{tmp_path}/out", blocks), "height", "relevant", "total")

    block("a", 1, 10, ("t", sale), ("u", other))
    block("b", 2, None, ("v", sale))
    block("c", 3, 4)
    assert run() == [(1, 1, 10), (2, 1, 1), (3, 0, 4)]
    per_batch = relevance.batch_relevance(spark, f"{tmp_path}/out")
    assert rows(per_batch, "relevant", "total") == [(2, 15)]
    # The transaction of block 2 turns up in block 40,000 instead: one event, where it now is.
    block("d", 40_000, 5, ("v", sale))
    assert run() == [(1, 1, 10), (2, 0, 1), (3, 0, 4), (40_000, 1, 5)]
    assert rows(relevance.batch_relevance(spark, f"{tmp_path}/out"), "relevant", "total") == [(1, 5), (2, 15)]
    assert not list((tmp_path / "out" / "_stage" / "built").iterdir())


def test_the_lines_of_a_batch_are_read_once(spark, tmp_path, monkeypatch):
    lab = labels(spark, exchanges=["E"])
    sale = {"vin": [{"addresses": ["E"], "value": "100"}], "vout": [{"scriptPubKey": {"addresses": ["x"]}, "value": "100", "n": 0}]}
    plans = []
    flat = ingest.normalize_ledger

    def watched(landed):
        plans.append(landed._jdf.queryExecution().executedPlan().toString())
        return flat(landed)

    monkeypatch.setattr(ingest, "normalize_ledger", watched)
    block = {"height": 1, "time": 30, "hash": "a", "txs": [{"txid": "t", **sale}], "txDetails": [{"txid": "t", "kind": "transfer"}]}
    tx = {"txid": "u", **sale, "blockHeight": 2, "blockTime": 60, "txIndex": 0, "kind": "transfer"}
    for name, follow, line in (("blocks", ingest.stream_blocks, block), ("txs", ingest.stream_ingest, tx)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps(line))
        follow(
            spark, f"{tmp_path}/{name}", f"{tmp_path}/out", f"{tmp_path}/cp-{name}", lambda: lab, trigger={"availableNow": True}
        ).awaitTermination()
    assert rows(ingest.stored_events(spark, f"{tmp_path}/out"), "txid", "block_height") == [("t", 1), ("u", 2)]
    assert len(plans) == 2 and all("Scan parquet" in p and "ExistingRDD" not in p for p in plans), plans
    assert not list((tmp_path / "out" / "_stage" / "lines").iterdir())

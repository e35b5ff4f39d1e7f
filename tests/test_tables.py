"""Upserts, overlays on top of them, retention, scans."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import scans, tables
from ledgerflow.operators.attribution import attribution_candidates
from ledgerflow.operators.events import build_flow_events, cap_per_block
from ledgerflow.operators.labels import node_operators, top_node_operators
from ledgerflow.operators.numbering import number_rows
from tests.chain import labels, ledger, nodes, rows


def events(spark):
    led = ledger(spark, ("a", 5, ["E"], ["x", "y"]), ("b", 30_000, ["E"], ["x"]))
    return build_flow_events(led, labels(spark, exchanges=["E"]))


def test_upsert_is_idempotent_and_newest_wins(spark):
    base = spark.createDataFrame([(1, 1, "old"), (2, 1, "kept")], "k INT, seq INT, v STRING")
    new = spark.createDataFrame([(1, 1, "x"), (1, 2, "new"), (3, 1, "added")], "k INT, seq INT, v STRING")
    once = tables.upsert(base, new, ["k"], ["seq"])
    expected = [(1, "new"), (2, "kept"), (3, "added")]
    assert rows(once, "k", "v") == expected
    assert rows(tables.upsert(once, new, ["k"], ["seq"]), "k", "v") == expected


def test_rank_limit_is_applied_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 2 AS k", "id AS seq")
    plan = tables.newest_per_key(df, ["k"], [F.desc("seq")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_replacing_an_event_keeps_attribution_unless_reset(spark):
    base = events(spark)
    attributed = base.withColumns(
        {
            "to_type": F.when(F.col("to_address") == "x", "node_operator").otherwise(F.col("to_type")),
            "classification_level": F.when(F.col("to_address") == "x", 1).otherwise(0),
            "data_source": F.when(F.col("to_address") == "x", "enhanced").otherwise("sync"),
        }
    )
    columns = ["txid", "vout", "to_type", "classification_level", "data_source"]
    kept = tables.upsert_events(attributed, base)
    assert rows(kept, *columns) == rows(attributed, *columns)
    assert rows(tables.upsert_events(attributed, base, reset=True), *columns) == rows(base, *columns)


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    path, stage = str(tmp_path / "t"), str(tmp_path / "stage")

    def batch(*items):
        return spark.createDataFrame(list(items), "height BIGINT, v STRING")

    def merge(base, new):
        return tables.upsert(base, new, ["height"], ["v"])

    tables.merge_into(path, batch((1, "a"), (50_000, "b")), merge, "height", f"{stage}/0", ["height"])
    untouched = sorted(p.name for p in (tmp_path / "t" / "height_bucket=2").glob("*.parquet"))
    for _ in range(2):  # a repeated batch publishes the same rows again
        tables.merge_into(path, batch((1, "c"), (2, "d")), merge, "height", f"{stage}/1", ["height"])
    assert rows(spark.read.parquet(path), "height", "v") == [(1, "c"), (2, "d"), (50_000, "b")]
    assert untouched == sorted(p.name for p in (tmp_path / "t" / "height_bucket=2").glob("*.parquet"))


def test_a_key_that_moves_leaves_its_old_bucket(spark, tmp_path):
    path = str(tmp_path / "t")

    def put(n, *items):
        batch = spark.createDataFrame(list(items), "k STRING, height BIGINT, v STRING")
        tables.merge_into(path, batch, lambda base, new: tables.upsert(base, new, ["k"], ["height"]), "height", str(tmp_path / f"s{n}"), ["k"])

    put(0, ("a", 20_159, "old"), ("b", 20_159, "stays"), ("c", 90_000, "alone"))
    put(1, ("a", 20_161, "new"), ("c", 5, "moved"))
    assert rows(spark.read.parquet(path), "k", "height", "v") == [("a", 20_161, "new"), ("b", 20_159, "stays"), ("c", 5, "moved")]
    assert not (tmp_path / "t" / "height_bucket=4").exists() and not (tmp_path / "s1").exists()


def test_retention(spark):
    chain = spark.createDataFrame([(h,) for h in (1, 100, 101, 600_100)], "height BIGINT")
    tip = chain.agg(F.max("height")).scalar()
    assert rows(tables.retain(chain, tip, 600_000, "height"), "height") == [(100,), (101,), (600_100,)]
    ev = chain.withColumnRenamed("height", "block_height")
    report = tables.retention_report(chain, ev, ev, tip, 600_000)
    assert rows(report, "blocks", "transactions", "flow_events") == [(1, 1, 1)]
    assert rows(tables.retention_due(chain), "span", "due") == [(600_099, True)]
    assert rows(tables.retention_due(chain, last_cleanup=599_500), "due") == [(False,)]
    assert rows(tables.retention_due(chain.filter("height < 1000")), "due") == [(False,)]


def test_scans(spark):
    ev = events(spark).withColumn("height_bucket", F.expr("block_height div 20160"))
    assert rows(scans.flow_events_between(ev, 5, 29_999), "txid", "vout") == [("a", 0), ("a", 1)]
    ordered = scans.flow_events_between(ev, 0, 99_999, ordered=True).collect()
    assert [(r.txid, r.vout) for r in ordered] == [("b", 0), ("a", 1), ("a", 0)]
    assert rows(scans.lookup(ev, txid="a", vout=1), "to_address") == [("y",)]
    assert rows(scans.lookup(ev, block_height=30_000), "txid") == [("b",)]
    assert rows(scans.latest_block(ev.withColumnRenamed("block_height", "height")), "txid") == [("b",)]


def test_limits_below_one_are_errors(spark):
    led = ledger(spark, ("a", 5, ["E"], ["x"]))
    operators = node_operators(nodes(spark, "N"))
    for n in (0, -1):
        for call in (
            lambda: top_node_operators(operators, n),
            lambda: cap_per_block(led, n),
            lambda: attribution_candidates(events(spark), 0, cap=n),
        ):
            with pytest.raises(ValueError):
                call()


def test_crowded_groups_are_numbered_in_parts(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id * 7919 % 1009 AS a", "id AS b")
    got = number_rows(df, "k", ["a", "b"], "a div 10", "n", group_rows=100)
    groups = {}
    for k, a, b, n in rows(got, "k", "a", "b", "n"):
        groups.setdefault(k, []).append((a, b, n))
    assert len(groups["hot"]) > 600
    for members in groups.values():
        assert [n for _, _, n in sorted(members)] == list(range(len(members)))


def test_numbered_rows_meet_their_key_without_another_shuffle(spark):
    df = spark.range(400).selectExpr("concat('k', id % 50) AS k", "id AS a")
    heads = spark.range(50).selectExpr("concat('k', id) AS k", "id AS h")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = number_rows(df, "k", ["a"], "a div 10", "n").join(heads, "k")
        assert sorted(r.n for r in got.collect()) == sorted(i // 50 for i in range(400))
        final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert final.count("Exchange hashpartitioning(k#") == 2  # the rows once, the heads once


def test_numbers_of_null_keys_and_equal_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 2), ("a", 2), ("a", 1)], "k string, a int")
    for most in (1, 10):
        got = number_rows(df, "k", ["a"], "a", "n", group_rows=most)
        assert sorted(rows(got, "k", "a", "n"), key=str) == sorted([(None, 1, 0), (None, 1, 1), ("a", 1, 0), ("a", 2, 1), ("a", 2, 2)], key=str)

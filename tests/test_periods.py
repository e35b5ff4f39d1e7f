"""Height frames, summaries, coverage."""

import pytest

from ledgerflow.constants import period_blocks
from ledgerflow.operators import coverage, periods, summary
from ledgerflow.operators.events import build_flow_events
from tests.chain import labels, ledger, rows


def blocks(spark, *heights):
    return spark.createDataFrame([(h,) for h in heights], "height BIGINT")


@pytest.fixture(scope="module")
def lab(spark):
    return labels(spark, exchanges=["E"], operators=["N"], foundation=["F"])


def test_frame_is_inclusive_and_follows_the_blocks(spark, lab):
    led = ledger(spark, ("old", 10_000, ["E"], ["x"]), ("edge", 10_001, ["E"], ["x"]), ("new", 12_000, ["E"], ["x"]))
    ev = build_flow_events(led, lab)
    # The newest block has no event and still moves the frame.
    chain = blocks(spark, 10_000, 10_001, 12_000, 12_881)
    assert rows(periods.period_slice(ev, chain, "24h"), "txid") == [("edge",), ("new",)]
    sliced = build_flow_events(periods.ledger_slice(led, chain, "24H"), lab)
    assert rows(sliced, "txid") == [("edge",), ("new",)]


def test_no_blocks(spark, lab):
    ev = build_flow_events(ledger(spark, ("t", 5, ["E"], ["x"])), lab)
    nothing = blocks(spark)
    empty = periods.period_slice(ev, nothing, "7D")
    assert empty.count() == 0
    assert rows(summary.event_range(empty), "newest", "oldest", "events") == [(0, 0, 0)]
    ready = coverage.period_readiness(nothing)
    assert set(rows(ready, "ready", "partial", "progress")) == {(False, False, 0.0)}
    assert rows(summary.flow_summary(empty), "flow_type", "total", "events") == [
        ("buying", 0.0, 0), ("p2p", 0.0, 0), ("selling", 0.0, 0),
    ]


def test_unknown_period_is_an_error():
    with pytest.raises(ValueError):
        period_blocks("1Y")


def test_tie_is_bearish_and_zero_total_is_zero_percent(spark, lab):
    led = ledger(spark, ("b", 5, ["E"], ["x"]), ("s", 5, ["y"], ["E"]))
    ev = build_flow_events(led, lab)
    assert rows(summary.sentiment(ev), "sentiment", "difference") == [("Bearish", 0.0)]
    none = summary.category_series(ev.limit(0))
    assert set(rows(none, "value", "events", "percentage", "bar_height")) == {(0.0, 0, 0.0, 0.0)}
    assert rows(summary.category_series(ev), "category", "percentage", "bar_height")[-1] == ("toUnknown", 100.0, 100.0)


def test_breakdown_adds_up(spark, lab):
    led = ledger(
        spark, ("b", 5, ["E"], ["x", "N", "F", "E"]), ("s", 6, ["N"], ["E", "x"]), ("p", 6, ["F"], ["x"])
    )
    ev = build_flow_events(led, lab)
    parts = rows(summary.flow_breakdown(ev), "flow_type", "party_type", "total", "events")
    assert ("buying", "node_operator", 2.0, 1) in parts and ("selling", "foundation", 0.0, 0) in parts
    totals = {t: (a, n) for t, a, n in rows(summary.flow_summary(ev), "flow_type", "total", "events")}
    for side in ("buying", "selling"):
        assert sum(p[2] for p in parts if p[0] == side) == totals[side][0]
        assert sum(p[3] for p in parts if p[0] == side) == totals[side][1]
    assert sum(n for _, n in totals.values()) == ev.count()
    assert rows(summary.by_exchange(ev), "flow_type", "exchange", "total", "events") == [
        ("buying", "name-E", 6.0, 3), ("selling", "name-E", 1.0, 1),
    ]


def test_all_periods_equal_single_periods(spark, lab):
    heights = [600_000, 599_000, 590_000, 540_000, 400_000, 100_000, 10]
    led = ledger(spark, *[(f"t{h}", h, ["E"], ["x"]) for h in heights])
    ev, chain = build_flow_events(led, lab), blocks(spark, 600_000)
    together = dict(rows(summary.net_flow_all_periods(ev, chain), "period", "net_flow"))
    assert together == {"24H": 2.0, "7D": 3.0, "30D": 4.0, "90D": 5.0, "6M": 6.0}
    for period, net in together.items():
        assert rows(summary.net_flow(periods.period_slice(ev, chain, period)), "net_flow") == [(net,)]


def test_top_buyers(spark, lab):
    led = ledger(
        spark, ("a", 5, ["E"], ["x", "y"]), ("b", 6, ["E"], ["x"]), ("c", 7, ["E"], ["z", "w"]), ("d", 8, ["q"], ["E"])
    )
    ev = build_flow_events(led, lab)
    top = summary.top_buyers(ev, 3).collect()
    # Equal totals: the newest event first, inside a block the later output.
    assert [(r.address, r.total_bought, r.event_count, r.exchanges) for r in top] == [
        ("w", 2.0, 1, ["name-E"]), ("x", 2.0, 2, ["name-E"]), ("y", 2.0, 1, ["name-E"]),
    ]
    assert rows(summary.top_sellers(ev), "address", "total_sold") == [("q", 1.0)]
    with pytest.raises(ValueError):
        summary.top_buyers(ev, 0)


def test_gaps_inside_and_across_buckets(spark):
    chain = blocks(spark, 1, 2, 5, 6, 20_159, 20_160, 20_163, 80_000)
    assert rows(coverage.block_gaps(chain), "from_height", "to_height", "missing") == [
        (20_161, 20_162, 2), (20_164, 79_999, 59_836), (3, 4, 2), (7, 20_158, 20_152),
    ]


def test_coverage_and_readiness(spark):
    chain = blocks(spark, *range(1, 2881))
    got = coverage.coverage_stats(chain).first()
    assert (got.blocks, got.min_height, got.max_height, got.span, got.age_days) == (2880, 1, 2880, 2879, 1.0)
    ready = {r.period: (r.ready, r.partial, r.progress) for r in coverage.period_readiness(chain).collect()}
    assert ready["24H"] == (True, False, 100.0) and ready["7D"] == (False, True, 14.3)
    one = coverage.ledger_counts(chain, chain, chain).first()
    assert (one.blocks, one.transactions, one.flow_events, one.latest_height) == (2880, 2880, 2880, 2880)


def test_a_period_of_a_stored_table_prunes_its_partitions(spark, tmp_path):
    path = str(tmp_path / "ev")
    spark.range(300_000).selectExpr("id AS block_height", "id div 20160 AS height_bucket").filter("block_height % 1000 = 0").write.partitionBy(
        "height_bucket"
    ).parquet(path)
    ev = spark.read.parquet(path)
    # Files outside the last day's week cannot be read any more; nothing opens them.
    for file in (tmp_path / "ev").glob("height_bucket=*/*.parquet"):
        if file.parent.name != "height_bucket=14":
            (file.parent / f".{file.name}.crc").unlink()
            file.write_bytes(b"no parquet")
    found = periods.period_slice(ev, spark.range(299_001).selectExpr("id AS height"), "24H")
    assert sorted(r.block_height for r in found.select("block_height").collect()) == [297_000, 298_000, 299_000]

"""What is kept between runs: attempts, adjacency tables, totals, retention."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import events as operators_events
from ledgerflow.operators import history, tables
from ledgerflow.operators.adjacency import TABLES, Adjacency
from ledgerflow.operators.attempts import AttributedEvents, folded
from ledgerflow.operators.attribution import Evidence, attribute_unknowns, multi_hop
from ledgerflow.operators.coverage import height_bucket
from ledgerflow.operators.events import build_flow_events
from ledgerflow.operators.labels import node_operators
from ledgerflow.streaming import totals
from tests.chain import labels, ledger, nodes, rows

HOUR = 3_600


def chain(spark):
    """E sells to a and b; a passes on to the operator N, b to nobody."""
    return ledger(
        spark, ("t1", 100, ["E"], ["a"]), ("t2", 101, ["E"], ["b"]), ("t3", 200, ["a"], ["N"]), ("t4", 201, ["q"], ["E"]), ("t5", 30_000, ["E"], ["c"]),
    )


def stored(spark, tmp_path, led):
    ev = build_flow_events(led, labels(spark, exchanges=["E"], operators=["N"]))
    path = f"{tmp_path}/events"
    tables.write_buckets(ev.withColumn("height_bucket", height_bucket(F.col("block_height"))), path, "block_height")
    return AttributedEvents(spark, path, f"{tmp_path}/attempts")


def test_runs_decide_what_the_next_one_asks(spark, tmp_path):
    led = chain(spark)
    kept = stored(spark, tmp_path, led)
    proof = Evidence.of(led, node_operators(nodes(spark, "N")))
    count = lambda report: sum(r.events for r in report.collect())
    assert count(kept.cycle(proof, 1_000_000)) == 4
    state = ["txid", "to_type", "from_type", "classification_level", "analysis_timestamp", "data_source"]
    first = rows(kept.events(), *state)
    assert ("t1", "node_operator", "exchange", 1, 1_000_000, "enhanced") in first and ("t2", "unknown", "exchange", 0, 1_000_000, "sync") in first
    # The same run again replaces its own attempts; inside the cool-down nothing is due.
    assert count(kept.cycle(proof, 1_000_000)) == 4 and rows(kept.events(), *state) == first
    assert kept.cycle(proof, 1_000_000 + 23 * HOUR) is None
    # Afterwards only what is still open; it keeps the time of the new attempt.
    later = 1_000_000 + 25 * HOUR
    assert count(kept.cycle(proof, later)) == 3
    second = rows(kept.events(), *state)
    assert [r for r in second if r[5] == "enhanced"] == [r for r in first if r[5] == "enhanced"]
    assert {r[4] for r in second if r[5] == "sync"} == {later, None}
    kept.compact(later)
    assert rows(kept.events(), *state) == second and kept.attempts().select("run").distinct().count() == 1
    assert kept.cycle(proof, later + HOUR) is None


def test_attempts_fold_column_by_column(spark):
    led = chain(spark)
    ev = build_flow_events(led, labels(spark, exchanges=["E"], operators=["N"]))
    overlay = attribute_unknowns(ev, Evidence.of(led, node_operators(nodes(spark, "N"))), 5).filter("txid = 't1'")
    later = overlay.withColumns({"updates": F.array(F.lit("analysis_timestamp")), "analysis_timestamp": F.lit(9).cast("bigint")})
    both = overlay.withColumn("run", F.lit(5)).unionByName(later.withColumn("run", F.lit(9)))
    got = folded(both).first()
    assert got.to_type == "node_operator" and got.analysis_timestamp == 9 and got.intermediary_wallet == "a" and "hop_chain" in got.updates


def test_adjacency_equals_evidence_and_stays_where_it_is(spark):
    led = ledger(
        spark, *[(f"m{i}", 50 + i, [], [f"w{i % 5}"], "coinbase") for i in range(30)],
        *[(f"t{i}", 100 + 7 * i % 400, [f"w{i % 11}"], [f"w{(i * 5 + 1) % 13}", f"w{i % 7}"]) for i in range(120)],
    )
    operators = node_operators(nodes(spark, "w3"))
    kept = Adjacency.of(spark, "adjacent", operators, buckets=4)
    half = F.pmod(F.xxhash64("txid"), F.lit(2))
    for batch in (0, 1, 0):
        kept.extend(led.filter(half == batch), f"b{batch}")
    assert kept.table("earners").distinct().count() == 5 and spark.table("adjacent_history").select("batch").distinct().count() == 2
    probes = spark.createDataFrame([(s, f"w{i % 13}", 60 + 5 * i, (60 + 5 * i) * 30) for i in range(60) for s in ("buying", "selling")], "side STRING, wallet STRING, height BIGINT, block_time BIGINT")
    plain = Evidence.of(led, operators)
    columns = multi_hop(probes, plain).columns
    assert rows(multi_hop(probes, kept), *columns) == rows(multi_hop(probes, plain), *columns)
    # Every lookup leaves its table where it lies: the side of the scan has no exchange.
    for frame, table in (
        (kept.past(probes.withColumn("direction", F.lit("sent")), 87_600), "history"),
        (kept.mentions(probes.selectExpr("wallet AS txid").distinct()), "mentions"),
        (kept.receipts_of(probes, 87_600), "receipts"),
        (kept.hopper("buying")(probes), "sent"),
        (kept.hopper("selling")(probes), "received"),
    ):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = frame._jdf.queryExecution().sparkPlan().toString(), frame._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        lines = plan[1].splitlines()
        scans = [n for n, line in enumerate(lines) if f"adjacent_{table}" in line and "Scan" in line]
        assert scans
        for n in scans:
            depth = lines[n].index("FileScan")
            above = [line for line in lines[:n] if len(line) - len(line.lstrip(" :+-")) < depth]
            up, level = [], depth
            for line in reversed(above):
                at = len(line) - len(line.lstrip(" :+-"))
                if at < level:
                    up.append(line.strip(" :+-"))
                    level = at
                if "Join" in line:
                    break
            assert not any(line.startswith("Exchange") for line in up), (table, up)


@pytest.mark.parametrize("seed", [1, 2])
def test_hops_where_time_falls_as_height_rises(spark, seed):
    import random

    dice = random.Random(seed)
    heights = dice.sample(range(1, 400_000), 300)
    edges = [(f"w{dice.randint(0, 3)}", h, dice.randint(0, 1_000), n, f"t{n}", f"x{n}") for n, h in enumerate(heights)]
    frame = spark.createDataFrame(edges, "wallet STRING, height BIGINT, block_time BIGINT, tx_index BIGINT, txid STRING, next_wallet STRING")
    asked = [(f"w{dice.randint(0, 4)}", dice.randint(1, 400_000), dice.randint(0, 1_000)) for _ in range(80)]
    probes = spark.createDataFrame(asked, "wallet STRING, height BIGINT, block_time BIGINT")
    fits = {
        "prev": lambda w, h, t: max(((e[1], e[4]) for e in edges if e[0] == w and e[1] < h and e[2] < t), default=None),
        "next": lambda w, h, t: max(((e[1], e[4]) for e in edges if e[0] == w and e[1] > h and e[2] > t), default=None),
        "oldest": lambda w, h, t: min(((e[1], e[4]) for e in edges if e[0] == w and e[1] > h and e[2] > t), default=None),
    }
    expect = lambda way: sorted((w, h, *reversed(f)) for w, h, t in set(asked) if (f := fits[way](w, h, t)))
    got = lambda df: sorted(tuple(r) for r in df.select("wallet", "height", "hop_txid", "hop_height").collect())
    assert got(history.prev_hop(probes, frame)) == expect("prev")
    assert got(history.next_hop(probes, frame)) == expect("next")
    assert got(history.next_hop(probes, frame, "oldest")) == expect("oldest")
    # The index alone, in two batches.
    index = history.hop_index(frame.filter("tx_index % 2 = 0")).unionByName(history.hop_index(frame.filter("tx_index % 2 = 1")))
    assert got(history._hop(history.search(history._asked(probes), index, later=False))) == expect("prev")
    after = history.search(history._asked(probes), index, later=True, anywhere=True).filter("edge.hop_height > height")
    assert got(history._hop(after)) == expect("next")


def test_retention_drops_weeks_and_cuts_one(spark, tmp_path):
    def put(name, heights):
        df = spark.createDataFrame([(h,) for h in heights], "height BIGINT").withColumn("height_bucket", height_bucket(F.col("height")))
        tables.write_buckets(df, f"{tmp_path}/{name}", "height")

    put("a", [1, 30_000, 40_400, 50_000, 50_001, 90_000])
    put("b", [50_000, 50_001])
    kept_file = next((tmp_path / "a" / "height_bucket=4").glob("*.parquet")).name
    places = {n: (f"{tmp_path}/{n}", "height") for n in ("a", "b", "missing")}
    for deleted, dropped in ((4, 2), (0, 0)):  # a second run finds nothing
        report = {r.part: r for r in tables.apply_retention(spark, places, 100_000, keep=49_999).collect()}
        assert (report["a"].rows_deleted, report["a"].weeks_dropped, report["b"].rows_deleted) == (deleted, dropped, 1 if deleted else 0)
        assert rows(spark.read.parquet(f"{tmp_path}/a"), "height") == [(50_001,), (90_000,)]
    assert sorted(p.name for p in (tmp_path / "a").glob("height_bucket=*")) == ["height_bucket=2", "height_bucket=4"]
    assert len(list(tmp_path.glob("a/*/*.parquet"))) == 2 and (tmp_path / "a" / "height_bucket=4" / kept_file).exists()


def test_totals_follow_replaced_events_once(spark, tmp_path):
    lab = labels(spark, exchanges=["E"])
    first = build_flow_events(ledger(spark, ("a", 5, ["E"], ["x", "y"]), ("b", 6, ["E"], ["x"])), lab)
    moved = build_flow_events(ledger(spark, ("b", 30_000, ["E"], ["x"])), lab)

    def put(ev, batch):
        tables.merge_into(
            f"{tmp_path}/flow_events", ev, tables.upsert_events, "block_height", f"{tmp_path}/stage/{batch}", ["txid", "vout"],
            effects=totals.flow_deltas, effects_path=f"{tmp_path}/flow_totals/batch={batch}",
        )

    for ev, batch in ((first, "one"), (moved, "two"), (moved, "two"), (first.filter("txid = 'a'"), "three")):
        put(ev, batch)
        stored = spark.read.parquet(f"{tmp_path}/flow_events")
        columns = ["flow_type", "height_bucket", "satoshi", "events"]
        assert rows(totals.maintained_totals(spark, str(tmp_path)), *columns) == rows(totals.flow_totals(stored), *columns)
    assert rows(totals.maintained_totals(spark, str(tmp_path)), "height_bucket", "events") == [(0, 2), (1, 1)]


def test_senders_that_are_given_are_not_looked_for_again(spark, monkeypatch):
    led, lab = chain(spark), labels(spark, exchanges=["E"], operators=["N"])
    found = operators_events.senders(operators_events.transfers_only(led), lab)
    monkeypatch.setattr(operators_events, "senders", lambda *a: pytest.fail("looked for again"))
    operators_events.build_flow_events(led, lab, found)
    operators_events.relevant_only(led, lab, found)

"""Hard negatives against brute force, with ties, odd rows and values beyond doubles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import negatives
from ledgerflow.llm.negatives import Best, Lists

COLUMNS = "vec_id long, embedding array<double>, label int, score int, slot string"


def clipped(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def brute(rows, low=50, high=95):
    usable = [(i, y, [clipped(math.floor(256 * x)) for x in v]) for i, v, y in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, y, v in usable:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, (y, v)), (y, v))
    out = []
    for a, (label, q) in asked.items():
        scored = sorted((-clipped(sum(x * y for x, y in zip(q, v))), i, y) for i, y, v in usable if i != a)
        for s, positive, _ in [p for p in scored if p[2] == label][:5]:
            fits = [(i, -n) for n, i, y in scored if y != label and low * -s <= 100 * -n <= high * -s]
            out += [(a, positive, r, i, -s, n) for r, (i, n) in enumerate(fits[:3], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 7, "x") for i, v, y in rows], COLUMNS)


@pytest.mark.parametrize("scale, dims, chunk", [(1.0, 12, 8192), (1.0, 12, 37), (1e8, 9, 64), (1e13, 4, 50), (0.0, 3, 8192)])
def test_equals_brute_force(spark, monkeypatch, scale, dims, chunk):
    monkeypatch.setattr(negatives, "SCORES_IN_CELL", 400)
    monkeypatch.setattr(negatives, "ANCHORS_IN_CELL", 3)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(3, dims))
    rows = [(i, ((centres[i % 3] + rng.normal(size=dims)) * scale).tolist(), int(rng.integers(0, 4))) for i in range(420)]
    rows += [(500 + i, rows[i % 5][1], i % 3) for i in range(60)]  # ties
    rows += [(2_000, None, 1), (2_050, [1.0, None], 1), (2_100, [float("nan")] * dims, 1), (2_150, [1.0] * dims, None), (None, [1.0] * dims, 1), (2_200, [], 2), (2_201, [2.5], 0)]
    got = negatives.hard_negatives(frame(spark, rows).repartition(5), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    # Chunks of any size stop at the same answers.
    lists_of = lambda part: Lists(np.arange(len(part)), np.zeros(len(part)), part)
    m = rng.integers(-9, 9, (200, 5))
    best = Best([(-5, 60), (20, 10), (30, 2**70)], 3)
    for at in range(0, 200, chunk):
        part = lists_of(m[at : at + chunk])
        part.ids = np.arange(at, min(at + chunk, 200))
        part.search(m[0], np.ones(len(part.ids), bool), best)
    scores = m @ m[0]
    for (low, high), ids in zip([(-5, 60), (20, 10), (30, 2**70)], best.ids, strict=True):
        assert ids.tolist() == sorted((i for i in range(200) if low <= scores[i] <= high), key=lambda i: (-scores[i], i))[:3]


def test_lists_are_not_read_to_the_end():
    rng = np.random.default_rng(2)
    m = rng.integers(-5, 5, (5_000, 3))
    m[17] = 4_000
    read = []
    lists = Lists(np.arange(5_000), np.zeros(5_000), m)
    best = Best([(-(2**63), 2**63 - 1)], 1)
    offer = best.offer
    best.offer = lambda ids, scores: (read.append(len(ids)), offer(ids, scores))
    lists.search(np.array([3, 2, 1]), np.ones(5_000, bool), best)
    assert best.ids[0].tolist() == [17] and sum(read) < 100


def test_few_no_and_repeated_rows(spark):
    rows = [(0, [1.0], 1), (1, [2.0], 1), (2, [1.5], 2), (2, [1.5], 2), (50, [3.0], 1), (50, [3.0], 1), (100, [1.0], 9)]
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)
    # A repeated positive asks per row, as do repeated negatives answer.
    scores = {0: 256 * 256, 1: 256 * 512, 2: 256 * 384, 50: 256 * 768, 100: 256 * 256}
    expect = [(0, 50, 1, 2, scores[50], scores[2]), (0, 50, 2, 2, scores[50], scores[2])] * 2
    expect += [(0, 1, 1, 2, scores[1], scores[2]), (0, 1, 2, 2, scores[1], scores[2]), (0, 1, 3, 100, scores[1], scores[100])]
    expect += [(50, 1, 1, 2, 3 * scores[1], 3 * scores[2]), (50, 1, 2, 2, 3 * scores[1], 3 * scores[2]), (50, 1, 3, 100, 3 * scores[1], 3 * scores[100])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expect)
    assert negatives.hard_negatives(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(frame(spark, rows), F.col("vec_id") < 0).count() == 0
    assert negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

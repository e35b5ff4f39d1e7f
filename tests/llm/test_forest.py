"""The LSH forest against all pairs, with large groups, shared passages and odd rows."""

import random

import numpy as np
import pytest

from ledgerflow.llm import forest
from ledgerflow.llm.forest import labels_of, middles
from tests.llm.test_ngram_join import grams, reach


def brute(docs, n=4, percent=80):
    sets = {i: grams(t, n) for i, t in docs}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    least = reach(ids, edges)
    return sorted((i, len(sets[i]), least[i], least[i] == i) for i in ids)


@pytest.mark.parametrize("crowd, seed", [(1_024, 1), (16, 2), (4, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, crowd, seed):
    monkeypatch.setattr(forest, "CROWD", crowd)
    dice = random.Random(seed)
    prose = lambda n: [f"w{dice.randint(0, 400)}" for _ in range(n)]
    passage, docs = prose(60), []
    for i in range(100):  # a passage that many share
        docs.append((i, prose(dice.randint(0, 60)) + (passage if i % 3 == 0 else [])))
    base = prose(160)
    for i in range(150):  # copies around one text; most are close to it, not to each other
        copy = list(base)
        for _ in range(dice.randint(0, 9)):
            copy[dice.randrange(len(copy))] = f"z{dice.randint(0, 10**6)}"
        docs.append((1_000 + i, copy))
    for i in range(40):  # a chain: each a little further
        base = [*base[3:], f"c{i}", f"d{i}", f"e{i}"]
        docs.append((2_000 + i, list(base)))
    docs = [(i, " ".join(w)) for i, w in docs]
    docs += [(3_000 + i, docs[i][1].upper().replace(" ", "\t")) for i in range(0, 100, 7)]
    docs += [(4_000, None), (4_001, ""), (4_002, "one"), (4_003, "ONE"), (4_004, "one two"), (4_005, "one  two "), (4_006, "a b c d e"), (4_007, " ".join(prose(60_000)))]
    dice.shuffle(docs)
    frame = spark.createDataFrame([(a, b, 5, "r") for a, b in docs], "doc_id long, text string, n int, region string").repartition(7)
    assert sorted(tuple(r) for r in forest.near_duplicates(frame).collect()) == brute(docs)


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e"), (1, "a b c d e"), (1, "v w x y z"), (2, "V W X Y Z"), (3, "q r s t"), (None, "q r s t"), (5, ""), (None, "k l m n"), (None, None)], "doc_id long, text string"
    )
    got = sorted((tuple(r) for r in forest.near_duplicates(docs).collect()), key=str)
    expect = [(1, 2, 1, True)] * 3 + [(2, 2, 1, False), (3, 1, 3, True), (None, 1, 3, False), (5, 0, 5, True), (None, 1, None, True), (None, 0, None, True)]
    assert got == sorted(expect, key=str)
    assert forest.near_duplicates(docs.limit(0)).count() == 0
    assert forest.near_duplicates(docs.filter("doc_id = 5")).count() == 1


def test_minhashes_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8):
        common = rng.integers(-(2**63), 2**63 - 1, 900)
        own = int(900 * (1 - share) / share / 2)
        sets = [np.concatenate([common, rng.integers(-(2**63), 2**63 - 1, own)]) for _ in range(2)]
        labels = labels_of(np.concatenate(sets), np.array([0, len(sets[0])]))
        assert abs((labels[:, 0] == labels[:, 1]).mean() - share) < 0.1


def test_middle_of_a_region_is_its_most_usual_signature():
    region = np.array([1, 1, 1, 1, 2, 3, 3])
    deeper = np.array([5, 7, 7, 9, 1, 2, 3])
    assert middles(region, deeper).tolist() == [1, 1, 1, 1, 4, 5, 5]

"""The n-gram join against all pairs, with large groups and frequent n-grams."""

import random
import re

import pytest

from ledgerflow.llm import components as stars
from ledgerflow.llm import ngram_join
from ledgerflow.llm.components import components, extended


def grams(text, n=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def reach(ids, edges):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in ids}


def brute(docs):
    sets = {i: grams(t) for i, t in docs}
    ids = sorted(sets)
    edges = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
    ]
    least = reach(ids, edges)
    return sorted((i, len(sets[i]), least[i]) for i in ids)


@pytest.mark.parametrize("hot_least, seed", [(24, 1), (3, 2)])
def test_components_equal_all_pairs(spark, monkeypatch, hot_least, seed):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", hot_least)
    dice = random.Random(seed)
    prose = lambda n: [f"w{dice.randint(0, 400)}" for _ in range(n)]
    passage, docs = prose(50), []
    for i in range(120):
        docs.append((i, prose(dice.randint(0, 60)) + (passage if i % 3 == 0 else [])))
    base = prose(150)
    for i in range(120):  # near copies of one text, some of them too far from it
        copy = list(base)
        for _ in range(dice.randint(0, 5)):
            copy[dice.randrange(len(copy))] = f"z{dice.randint(0, 10**6)}"
        docs.append((1_000 + i, copy))
    for i in range(40):  # a chain: each a little further
        base = [*base[1:], f"c{i}"]
        docs.append((2_000 + i, list(base)))
    docs = [(i, " ".join(w)) for i, w in docs]
    docs += [(3_000 + i, docs[i][1].upper().replace(" ", "\t")) for i in range(0, 120, 7)]
    docs += [(4_000, None), (4_001, ""), (4_002, "one"), (4_003, "ONE"), (4_004, "one two"), (4_005, "one  two "), (4_006, "a b c d")]
    dice.shuffle(docs)
    frame = spark.createDataFrame([(a, b, 5) for a, b in docs], "doc_id long, text string, n int")
    assert sorted(tuple(r) for r in ngram_join.linked(frame).collect()) == brute(docs)


def test_repeated_ids_empty_table_and_filter(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "x y z"), (2, "X Y Z"), (3, "q r s"), (None, "q r s"), (5, "")], "doc_id long, text string")
    rows = [tuple(r) for r in ngram_join.linked(docs).collect()]
    assert sorted(rows, key=str) == sorted([(1, 2, 1), (1, 2, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (None, 1, 3), (5, 0, 5)], key=str)
    assert ngram_join.linked(docs.limit(0)).count() == 0
    kept = ngram_join.without_near_copies(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "1", "3", "5", "None"]


def test_components_of_long_and_wide_graphs(spark):
    dice = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 200)] + [(dice.randint(800, 999), dice.randint(800, 999)) for _ in range(80)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == reach(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_extended_by_more_edges(spark):
    dice = random.Random(4)
    first = [(dice.randint(0, 200), dice.randint(0, 200)) for _ in range(80)]
    more = [(dice.randint(0, 260), dice.randint(0, 260)) for _ in range(60)] + [(3, 3)]
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    got = {r.node: r.component for r in extended(components(frame(first)), frame(more)).collect()}
    edges = [e for e in first + more]
    whole = reach({x for e in edges for x in e}, [e for e in edges if e[0] != e[1]])
    assert all(got[n] == c for n, c in whole.items() if n in got) and {n for n, c in whole.items() if c != n} <= set(got)


def test_no_round_follows_once_all_edges_are_stars(spark, monkeypatch):
    rounds, large = [], stars._large_star
    monkeypatch.setattr(stars, "_large_star", lambda edges: rounds.append(1) or large(edges))
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    done = [(1, 5), (7, 1), (2, 3), (3, 2), (4, 4)]
    assert {r.node: r.component for r in components(frame(done)).collect()} == {1: 1, 5: 1, 7: 1, 2: 2, 3: 2} and not rounds
    for open_ in ([(5, 9), (7, 9)], [(5, 7), (7, 9)]):  # two centres, a centre that has one of its own
        assert {r.component for r in components(frame(open_)).collect()} == {5} and len(rounds) == 1
        rounds.clear()


def test_open_lists_are_made_anew_only_after_new_links(spark, monkeypatch):
    labels, stored = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda frame, label: labels.append(label) or stored(frame, label))
    docs = [(i, " ".join([f"w{k}" for k in range(60)] + [f"d{i}x{k}" for k in range(40)])) for i in range(12)]  # lists, but no link
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.linked(frame).collect()) == brute(docs)
    assert labels.count("open") == 1


def crowd(dice, members, words=120):
    """Near copies of one text, of which most pairs are below the threshold."""
    base = [f"w{dice.randint(0, 10**6)}" for _ in range(words)]
    docs = []
    for i in range(members):
        copy = list(base)
        for _ in range(2 if i % 3 else 1):
            copy[dice.randrange(words)] = f"z{dice.randint(0, 10**6)}"
        docs.append((i, " ".join(copy)))
    return docs


def test_a_crowd_leaves_few_pairs_for_the_last_round(spark, monkeypatch):
    docs, calls = crowd(random.Random(9), 240), []
    verified = ngram_join.Join.verified

    def counted(self, pairs):
        calls.append(pairs.count())
        return verified(self, pairs)

    monkeypatch.setattr(ngram_join.Join, "verified", counted)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.linked(frame).collect()) == brute(docs)
    assert calls[-1] < 1.5 * len(docs)


@pytest.mark.parametrize("first", [1, 16])
def test_pairs_made_once_lose_no_link(spark, monkeypatch, first):
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "FIRST", first)
    docs = crowd(random.Random(10), 60)
    docs += [(1_000 + i, f"{docs[0][1]} tail{i // 2} more") for i in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.linked(frame).collect()) == brute(docs)


def test_a_pair_counts_in_one_list(spark):
    starts = {1: (10, [5, 7, 9]), 2: (10, [5, 7, 9]), 3: (11, [6, 7, 9]), 4: (12, [1, 2, 3])}
    lists = {**{g: [k for k, (_, start) in starts.items() if g in start] for g in range(10)}, 20: [3, 4], 21: [3, 4]}
    rows = [(g, node, *starts[node]) for g, nodes in lists.items() for node in nodes]
    rows = spark.createDataFrame(rows, "gram long, node long, `group` long, first array<long>")
    own = rows.filter("group = 10").select(ngram_join.group_list("group").alias("gram"), "node", "group", "first").distinct()
    rows = rows.unionByName(own)
    side = lambda s: rows.select("gram", *(rows[c].alias(s + c) for c in ("node", "group", "first")))
    pairs = side("x_").join(side("y_"), "gram").filter("x_node < y_node")
    made = pairs.filter(ngram_join.once(pairs.gram)).collect()
    assert sorted((r.x_node, r.y_node) for r in made) == [(1, 2), (1, 3), (2, 3), (3, 4), (3, 4)]
    assert {r.gram for r in made if r.y_node == 3} == {7}

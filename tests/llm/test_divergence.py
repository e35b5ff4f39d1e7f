"""The source audit against plain counting, with odd rows, many groups and narrow tiles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerflow.llm import divergence
from ledgerflow.llm.divergence import LEAF, SIDE, Tree, changes


def brute(docs, least=30, to=50):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        share = lambda c: [1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept]
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s, c in groups.items():
            parts = {
                "pair": [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in groups if o != s],
                "term": [(a - b, t) for t, a, b in zip(kept, p[s], q) if c[t] and a > b],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= to]
    return sorted(out)


@pytest.mark.parametrize("bucket, run", [(4096, 32), (7, 1)])
def test_equals_plain_counting(spark, monkeypatch, bucket, run):
    monkeypatch.setattr(divergence, "TERMS_IN_BUCKET", bucket)
    monkeypatch.setattr(divergence, "TILES_IN_RUN", run)
    monkeypatch.setattr(divergence, "FLUSH_BYTES", 100_000)
    dice = random.Random(bucket)
    words = [f"{a}{b}{c}" for a in "abcdéß京" for b in "XYZwvu" for c in "klmnopqrstuv"]
    text = lambda n: " ".join(dice.choice(words[: dice.randint(5, len(words))]) for _ in range(n))
    docs = [(text(dice.randint(0, 60)), "en", f"s{min(dice.randint(0, 40), 9)}") for _ in range(900)]
    docs += [("Straße straße ЖЖ ЖЖ _x_9y", "dé", "ü") for _ in range(31)] + [("ЖЖ", "dé", "z"), ("", "dé", "Z"), (None, "dé", None), (None, None, None), ("a b", None, "")]
    docs += [("hapax" * 9, "en", "s0"), ("\x00a\x00b", "en", "new"), ("a-b'c", "xx", "only")]
    docs += [(" ".join(["lots"] * 50_000), "en", "s1")] * 30
    dice.shuffle(docs)
    frame = spark.createDataFrame([(*d, 1, "r") for d in docs], "text string, lang string, source string, value int, term string").repartition(6)
    got = divergence.audited(frame)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs)


def test_more_groups_than_a_tile_has_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILES_IN_RUN", 1)
    dice = random.Random(5)
    docs = [(" ".join(f"w{chr(97 + min(dice.randint(0, 9), 5))}" for _ in range(5)), "en", f"s{n}") for n in range(530)]
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audited(frame, least_docs=3).collect()) == brute(docs, 3)


@pytest.mark.parametrize("share, rows", [(0.001, 512), (0.3, 40), (0.0, 3)])
def test_trees_walked_together_equal_dense_distances(share, rows):
    rng = np.random.default_rng(1)
    zeros, dense, trees = [], [], []
    for side in range(2):
        zero = np.zeros(SIDE, np.int64)
        zero[:rows] = rng.integers(5, 50, rows)
        m = np.broadcast_to(zero[:, None], (SIDE, SIDE)).copy()
        cells = np.flatnonzero(rng.random(SIDE * SIDE) < share)
        cells = cells[cells < rows * SIDE]
        if side and not share:
            cells = np.array([SIDE + 1])
        m.ravel()[cells] += rng.integers(1, 1000, len(cells))
        zeros.append(zero), dense.append(m)
        trees.append(Tree(cells, m.ravel()[cells], zero) if len(cells) else None)
    total = np.zeros((SIDE, SIDE), np.int64)
    changes(*trees, *zeros, total)
    total += SIDE * np.abs(zeros[0][:, None] - zeros[1])
    at = rng.integers(0, rows, 60), rng.integers(0, rows, 60)
    assert (total[at] == np.abs(dense[0][at[0]] - dense[1][at[1]]).sum(1)).all() and SIDE % LEAF == 0


def test_empty_table(spark):
    assert divergence.audited(spark.createDataFrame([], "text string, lang string, source string")).count() == 0

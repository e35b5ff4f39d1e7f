"""Suffix arrays and removed repeats against brute force."""

import hashlib
import random

import numpy as np
import pytest

from ledgerflow.llm import suffixes


def brute(docs, length):
    """{(id, n)} -> removed mask, for docs sorted by id; an equal (id, start) is not earlier."""
    first = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            first[key] = min(first.get(key, (doc_id, i)), (doc_id, i))
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (doc_id, i):
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_array_and_prefixes_equal_sorting():
    rng = np.random.default_rng(0)
    for n in [*range(30), 200, 1_000]:
        for letters in (1, 2, 4, 300):
            s = rng.integers(1, letters + 1, n)
            order = suffixes.suffix_array(s)
            plain = s.tolist()
            assert order.tolist() == sorted(range(n), key=lambda i: plain[i:])
            for length in (3, 9):
                data = s.astype(np.uint8)
                fits = order[order <= n - length]
                same = suffixes.equal_prefixes(data, fits, length)
                assert same.tolist() == [k > 0 and bytes(data[a : a + length]) == bytes(data[fits[k - 1] :][:length]) for k, a in enumerate(fits)]


@pytest.mark.parametrize("crowded", [4_000, 1])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    dice = random.Random(5)
    words = ["alpha", "béta", "gamma", "delta", "漢字", "x"]
    prose = lambda n: " ".join(dice.choice(words) + str(dice.randint(0, 99)) for _ in range(n))
    passage, line = prose(12), prose(4)
    docs = [(i, prose(dice.randint(0, 40)) + (passage if i % 3 == 0 else "") + prose(dice.randint(0, 20))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(8)]  # whole copies
    docs += [(200 + i, docs[i][1][3:] + "!") for i in range(8)]  # near copies
    docs += [(300, "ab" * 200), (301, "ab" * 150), (302, "a" * 500), (303, "word " * 80), (304, "xword " * 80)]  # periods
    docs += [(400 + i, prose(3) + line + prose(3)) for i in range(20)]
    docs += [(500, None), (501, ""), (502, "short"), (503, "é" * 60), (7, docs[7][1]), (9, prose(30))]
    dice.shuffle(docs)
    frame = spark.createDataFrame([(a, b, 1, "v") for a, b in docs], "doc_id long, text string, start int, version string")
    got = sorted(tuple(r) for r in suffixes.digests(frame, 60).collect())
    assert got == brute(docs, 60)


def test_pieces_of_a_long_text_agree(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3_000).astype(np.uint8)
    offsets = np.array([0, 700, 700, 750, 3_000])
    whole = suffixes.anchored(data, offsets, 100)
    monkeypatch.setattr(suffixes, "PIECE", 512)
    cut = suffixes.anchored(data, offsets, 100)

    def by_start(found):
        return {a + k: h for h, a, m, _ in zip(*(x.tolist() for x in found)) for k in range(m)}

    assert by_start(whole) == by_start(cut)
    assert sorted(by_start(whole)) == [*range(0, 601), *range(750, 2_901)]


def test_empty_table_and_kept_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.digests(empty).count() == 0
    docs = spark.createDataFrame([(1, "é" * 100, "a"), (2, "x" + "é" * 60 + "y", "b"), (3, None, "c")], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in suffixes.kept_texts(docs).collect()}
    assert rows[1].text == "é" and rows[2].text == "xy" and rows[2].lang == "b" and rows[3].text == ""

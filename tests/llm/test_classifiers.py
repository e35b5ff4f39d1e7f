"""Held-out accuracy of the quality and toxicity classifiers, their parts, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import quality, toxicity
from ledgerflow.llm.text import runs, shingle_hashes, span_hashes, words

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")


def accuracy(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).collect()
    good = [r.score for r in rows if r.y == 1]
    bad = [r.score for r in rows if r.y == 0]
    ordered = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    return ordered, np.mean([r.predicted == r.y for r in rows])


def test_quality_on_the_held_out_fold(tables):
    docs, labels = tables
    area, right = accuracy(quality.quality(docs, labels), labels, "quality")
    assert area > 0.95 and right > 0.93


def test_toxicity_on_the_held_out_fold(tables):
    docs, labels = tables
    area, right = accuracy(toxicity.toxicity(docs, labels), labels, "toxic")
    assert area > 0.75 and right > 0.93


@pytest.mark.parametrize("module, name, label", [(quality, "quality", "quality"), (toxicity, "toxicity", "toxic")])
def test_odd_rows_and_tables(spark, module, name, label):
    judge = getattr(module, name)
    texts = [None, "", " ", "x", "word " * 50_000, "good text here", "good text here", "you moron idiot", "dire moron words"] * 12
    docs = spark.createDataFrame([(i if i else None, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    flag = [int("moron" in (t or "")) for t in texts]
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(flag)] + [(1, None), (None, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.limit(0), labels.filter(f"{label} = 1")):
        rows = judge(docs, known).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id and texts[r.doc_id] == "good text here"}) == 1
    assert judge(docs.limit(0), labels).count() == 0


def test_spans_are_character_offsets(spark):
    clean, toxic = "é ruhig über alles wort", "é über MORON, idiot ruhig"
    docs = spark.createDataFrame([(i, toxic if i % 4 == 0 else clean) for i in range(1, 200)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("text") == toxic, 1).otherwise(0).alias("toxic"))
    row = toxicity.toxicity(docs, labels).filter("doc_id = 4").first()
    assert row.predicted == 1
    assert {toxic[s.begin : s.end] for s in row.spans} in ({"MORON, idiot"}, {"MORON", "idiot"})


def test_scan_equals_the_plain_recurrence():
    a, b, c, d = np.random.default_rng(0).random((4, 5_001))
    x, plain = 0.0, []
    for t in range(len(a)):
        x = (a[t] + b[t] * x) / (c[t] + d[t] * x)
        plain.append(x)
    assert np.allclose(toxicity.scan(a, b, c, d), plain)


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(2)
    field = toxicity.Field(np.zeros(1), rng.normal(size=5), np.zeros(3))
    e, first = np.exp(rng.normal(size=7)), np.array([0, 3, 3, 7])
    left, right = field.forward_backward(e, first)
    moves = np.exp(field.moves[:4]).reshape(2, 2)
    for a, b in ((0, 3), (3, 7)):
        weight = np.zeros((b - a, 2))
        for code in range(2 ** (b - a)):
            tags = [code >> k & 1 for k in range(b - a)]
            w = np.exp(field.moves[4]) if tags[0] else 1.0
            w *= np.prod([moves[x, y] for x, y in zip(tags, tags[1:])]) * np.prod([e[a + k] for k, t in enumerate(tags) if t])
            for k, t in enumerate(tags):
                weight[k, t] += w
        assert np.allclose((left * right)[a:b], weight[:, 1] / weight[:, 0])


def test_words_and_shingles_equal_plain_python():
    texts = ["", " a  b\tc ", None, "é b c d", "x", "a b", "b c d é b c d"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    seen = {}
    for limit in (1, 8, 10_000):
        row = 0
        for rows, data, offsets in runs(batch, "text", limit):
            start, end, first = words(data, offsets)
            hashes, owner = shingle_hashes(span_hashes(data, start, end), first, 3)
            for k in range(rows.num_rows):
                plain = (texts[row] or "").split()
                got = [bytes(data[start[j] : end[j]]).decode() for j in range(first[k], first[k + 1])]
                assert got == plain
                grams = [tuple(plain[i : i + 3]) for i in range(max(len(plain) - 2, min(1, len(plain))))]
                for gram, value in zip(grams, hashes[owner == k], strict=True):
                    assert seen.setdefault(gram, value) == value
                row += 1
        assert row == len(texts)
    assert len(set(seen.values())) == len(seen)

"""The pipeline stage by stage, each against a plain reading of what it is to do."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerflow.llm import ngram_join, quality, suffixes
from ledgerflow.llm.tables import stored
from tests.llm.test_ngram_join import grams, reach

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SMALL), name))
    return out


def test_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "decontamination", "bpe"]
    for step in steps[1:-1]:
        assert step.schema == steps[0].schema


def test_decisions_take_effect(spark, steps):
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = quality.quality(steps[0], labels).filter("predicted = 1").collect()
    assert set(rows[1]) == {r.doc_id for r in judged} and 0 < len(rows[1]) < len(rows[0])
    linked = ngram_join.linked(steps[1], n=5, percent=80).collect()
    assert set(rows[2]) == {r.component_id for r in linked}
    cut = {r.doc_id: r for r in suffixes.kept_texts(steps[2]).collect()}
    assert set(rows[3]) == {i for i, r in cut.items() if not r.n_removed or r.text}
    assert all(r.text == cut[i].text and r.n_chars == len(r.text) for i, r in rows[3].items())
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    dirty = {i for i, r in rows[3].items() if any(t in " ".join(r.text.lower().split()) for t in items)}
    assert dirty and not dirty & set(rows[4]) and len(rows[3]) - len(rows[4]) <= len(dirty) + 1
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        assert r.ids == library.encode(rows[4][i].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_odd_rows_pass_through_every_stage(spark):
    texts = [None, "", "one", "Good plain words in a row here. " * 30, "Good plain words in a row here. " * 30]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            frame = stored(stage(spark, frame, SMALL), "odd")
        assert frame.count() in (0, 4)


def test_near_copies_equal_all_pairs_of_five_words_at_80_percent(spark):
    dice = random.Random(6)
    prose = lambda n: [f"w{dice.randint(0, 900)}" for _ in range(n)]
    docs = []
    for _ in range(12):
        base = prose(dice.randint(100, 200))
        docs.append(base)
        for changed in (1, 2, 3, 4, 5, 8):  # on both sides of 0.80, one at a time or in a cluster
            copy, start = list(base), dice.randrange(80)
            for k in range(changed):
                copy[start + k if changed % 2 else dice.randrange(len(copy))] = f"z{dice.randint(0, 10**6)}"
            docs.append(copy)
    dice.shuffle(docs)
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    sets = {i: grams(t, 5) for i, t in docs}
    alike = lambda a, b, percent: 100 * len(a & b) >= percent * len(a | b)
    edges = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b], 80)]
    least = set(reach(sets, edges).values())
    threes = {i: grams(t) for i, t in docs}
    assert least < set(reach(sets, [(a, b) for a, b in edges if alike(threes[a], threes[b], 90)]).values())
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame, SMALL).collect()} == least


def test_stages_from_near_copies_on(spark, steps):
    """What the stages after the classifier give at sf0.001, with near copies at 5 words and 80 %."""
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    sets = {i: grams(r.text, 5) for i, r in rows[1].items()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(rows[2]) == set(reach(sets, edges).values())
    cut = {r.doc_id: r for r in suffixes.kept_texts(steps[2]).collect()}
    assert {i: r.text for i, r in rows[3].items()} == {i: r.text for i, r in cut.items() if not r.n_removed or r.text}
    assert set(rows[5]) == set(rows[4]) < set(rows[3])

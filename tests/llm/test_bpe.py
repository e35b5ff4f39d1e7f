"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerflow.llm import bpe
from ledgerflow.llm.bpe import CACHE_BYTES, WordBPE, decoded, digests, encoded

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "Σας ΣΑΣ", "<|endoftext|>x<|startoftext|>", "I'LL it's 'S", "İstanbul", "é ẛ̣", "a" * 40_000,
    "a\x1cb \x1d", "\x85x", "<|end", "½²Ⅳ 12", "漢字!?", "ﬁ ǅ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_and_text_as_the_library(library):
    bpe, dice = WordBPE(PATH), random.Random(7)
    letters = "aAbB'sS tTé́Σσςİ<|startoftext|><|endoftext|>\n\t   12٣½😀!?…漢字Åﬁ²\x00\x85\x1c"
    for text in [*ODD, *("".join(dice.choices(letters, k=dice.randint(1, 40))) for _ in range(800))]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rows_nulls_repeats_and_clashing_columns(spark, library):
    texts = [*ODD, None, "again", "again"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in digests(docs, PATH).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    kept = encoded(docs, PATH).collect()
    assert [r.n_tokens for r in kept] == ["x"] * len(texts)
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert digests(docs, PATH).count() == 0 and encoded(docs, PATH).count() == 0


def test_decoded_column_and_stage(spark, library):
    texts = [*ODD, None, "again", "again"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    shown = {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(texts)}
    assert {r.doc_id: r.decoded for r in corpus_pipeline.tokenised(spark, docs, "").collect()} == shown
    ids = spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id long, ids array<int>, text string")
    assert {r.doc_id: (r.decoded, r.text) for r in decoded(ids, PATH).collect()} == {1: (None, "x"), 2: ("", "y")}
    assert decoded(ids.limit(0), PATH).count() == 0


def test_the_words_of_a_task_are_merged_once():
    made = WordBPE(PATH)
    merged, asked = made.merged, []
    made.merged = lambda word: asked.append(word) or merged(word)
    words = [f"{k:05x}z" for k in range(120_000)]
    letters = ["".join(chr(97 + int(c, 16)) for c in w[:-1]) for w in words]  # no digits, one piece each
    for _ in range(2):
        for at in range(0, len(letters), 1000):
            made.parts(" ".join(letters[at : at + 1000]))
    assert len(asked) == len(set(letters)) and made.held <= CACHE_BYTES


def test_words_that_come_again_outlast_rare_ones(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 200_000)
    made, dice = WordBPE(PATH), random.Random(8)
    merged, asked = made.merged, []
    made.merged = lambda word: asked.append(word) or merged(word)
    rare = ["".join(dice.choices("abcdefgh", k=9)) for _ in range(5_000)]
    for at in range(0, len(rare), 50):
        text = " ".join([*rare[at : at + 50], "Commonest", "commonest", "éclair", "commonest!", "<|ENDOFTEXT|>", "<|endoftext|>", "i̇"])
        assert made.encode(text) == library.encode(text, add_special_tokens=False).ids and made.held <= 200_000
    assert [asked.count(w) for w in ("commonest", "éclair", "!")] == [1, 1, 1]

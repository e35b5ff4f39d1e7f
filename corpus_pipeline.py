"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a frame that ``run`` writes to the shared
folder and reads again as the next stage's documents, so a lost executor repeats one stage at
most. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import bpe, decontamination, ngram_join, quality, suffixes
from ledgerflow.llm.tables import fresh_path, table

#: No SQL states the classifier, the latent retrieval or the encoding.
ORACLE_SQL = None

#: What makes near copies of documents here: words of a shingle, least Jaccard similarity.
SHINGLE_WORDS = 5
SHINGLE_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach each other over similar sets of word shingles, the smallest id
    stays; unlike query op5, which takes three words and 90 %."""
    return ngram_join.without_near_copies(docs, n=SHINGLE_WORDS, percent=SHINGLE_PERCENT)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occurred before are cut out; documents left with nothing go."""
    left = suffixes.kept_texts(docs)
    return left.filter("n_removed = 0 or text <> ''").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids, decoded): the ids and the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    made = bpe.decoded(bpe.encoded(docs, path).drop("text"), path)
    return made.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_copies", one_of_each_group),
    ("repeats", repeats_removed),
    ("decontamination", decontaminated),
    ("bpe", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

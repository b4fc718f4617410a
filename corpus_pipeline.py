"""A training corpus from raw documents: five stages, each written and read again by the next.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of ``documents`` (extra ones too); the last returns
what the mix takes of each document.

Defined results: a document with a null or empty text, or without a letter, goes in the first stage.
Rows with a null doc_id have no order, so the second and third stage leave them as they are.  Rows
that repeat a doc_id with one text stay or go together; with different texts each is judged by its
own.  An empty table goes through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import decontaminate, jaccard, language, mixing, substrings
from pixelloom.llm.common import Scratch, release
from pixelloom.llm.queries import held_out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is not clear, go; so do null texts.  Where no
    language can be learned, all go."""
    return language.keep_identified(docs, language.train(docs, ~held_out()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest doc_id.  Null
    doc_ids stay."""
    return jaccard.keep_one(docs)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 13 words and more go, and with them documents that have nothing else.
    Rows with a null doc_id are unchanged."""
    return substrings.rewrite(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items all stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken; a row for each that came."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_substrings),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: A trained network and a random walk are in it; tests hold it against the stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = tuple(Scratch.live)  # of other queries
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        release(spark, keep=(*before, scratch.base))
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs

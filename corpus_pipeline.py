"""The corpus pipeline: reject toxic documents, keep one of each near-duplicate
group, remove benchmark contamination, mix the sources, write token shards.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
is written as Parquet and read again before the next one. All stages but the
last return the columns of ``documents``; extra columns pass through, whatever
their names, and an empty table stays empty. Texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, mixing, simhash, token_shards, toxicity
from lectern.llm.common import materialise, table

#: No source is taken more than this many times as often as another; every
#: document is taken once at least.
REPETITION = 1.25


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without rows that score 0.5 or more. A null text counts as empty;
    equal texts share their score, so repeated rows go or stay together; without
    both classes in the labels every row has the share of toxic labels as score."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group. Null and empty texts are
    near duplicates of each other; rows without an id all stay; repeated rows
    count once; rows of one id with different texts stay or go together."""
    return simhash.one_of_each(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without rows of which one word in twenty or more lies in a window
    of the benchmark. Null and empty texts have no words and stay; exactly one in
    twenty goes; repeated rows go or stay together."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once at least, those of small sources more often. A null source
    is the source ''; rows without tokens are taken once; rows of one id (null
    ids too) are taken as often as each other."""
    return mixing.mixed(docs, repetition=REPETITION, cover=True)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: a row for each row of ``docs``, in ascending
    doc_id order, null ids first; null and empty texts have the end id only;
    repeated rows follow one another."""
    return token_shards.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

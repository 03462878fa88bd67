"""The corpus pipeline: quality, exact and near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again
as the next stage's documents; all but the last return the columns of `documents`.

Defined cases, of all stages: an empty table gives an empty table. Columns other than doc_id, text
and source are carried along, whatever their names and nulls. Null text counts as empty, a null source
as "". Very long texts are read whole. What a stage does with nulls, ties and repeated rows is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, mixing, ngram_join, packing, quality
from quillspark.llm.common import cut

#: The mix: weights of 0.9 of the greatest entropy, no source repeated more than twice, and every
#: document at least once, since the stages before have chosen what is worth keeping.
MIX = {"entropy_share": 0.9, "repeat_limit": 2.0, "keep_all": True}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; those whose score is just the threshold stay, as do all if no row is labelled.

    A row is judged by its text alone, so repeated rows go or stay together, with or without a doc_id.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, once if that row repeats; a null doc_id only if there is no other."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the one with the smallest doc_id stays.

    Documents without words are linked with none and stay, as do rows without a doc_id. Rows that repeat the doc_id that stays all stay.
    """
    return ngram_join.keep_one(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: each document comes once at least, some of small sources twice. Documents with one doc_id and source go the same way."""
    return mixing.mixed_documents(docs, **MIX)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces in sequences of 4096 tokens: a row of its own for each piece of each row, an empty text being its end id."""
    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram join", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express the trained classifier and the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import chat_format, exact_dedup, html_wrapper, lm_score, media_gif, mixing, ngram_join, packing, pii, quality, spelling, token_align, token_counts


#: Setting of the session that holds the key of pseudonyms.
PII_KEY = "spark.quillspark.pii.key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_main_text(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of 0.95 of the greatest entropy, no source more than four times, as many tokens as the corpus has."""
    return mixing.mix(table(spark, sf_dir, "documents"), entropy_share=0.95, repeat_limit=4.0).select("doc_id", "source", "tokens", "weight", "epoch", "block", "block_order", "doc_order")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of the session; without one, over tables that hold no real person, a key that is no secret."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, "not a secret: invented tables only"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_gif.stored_media(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_conversations(said.unionByName(chat_format.probe(spark))))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_wrapper, op2_ngram_join, op3_mix_sources, op4_exact_dedup, op5_pii_pseudonyms,
        op6_token_counts, op7_best_fit_packing, op8_quality_rules, op9_pseudo_likelihood, op10_gif_media,
        op11_chat_format, op12_token_align, op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.SQL, "op4_exact_dedup": exact_dedup.SQL, "op11_chat_format": chat_format.SQL, "op13_spelling_variants": spelling.SQL,
}

"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeflow.llm import ann, html, langid, lexical, minhash, mixing, packing, passages, personal, resampling, tokens, toxicity, vectors
from stakeflow.session import configure
from stakeflow.sources import Tables


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(configure(spark), sf_dir)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_tables(spark, sf_dir).documents)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_tables(spark, sf_dir).pages)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return toxicity.score_toxicity(t.documents, t.labels)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(_tables(spark, sf_dir).documents)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_tables(spark, sf_dir).documents)


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_tables(spark, sf_dir).documents)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_tables(spark, sf_dir).documents).select("doc_id", "size", "source_size", "target", "taken")


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_tables(spark, sf_dir).embeddings)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(_tables(spark, sf_dir).documents)


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_vectors(_tables(spark, sf_dir).embeddings, F.col("vec_id") % 20 == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return resampling.resample(t.documents, t.benchmark)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return lexical.search_items(t.documents, t.benchmark)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(_tables(spark, sf_dir).documents)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_main_text, op3_toxicity, op4_near_dedup, op5_best_fit_packing,
        op6_repeated_passages, op7_source_mixing, op8_vector_dedup, op9_language_id, op10_nearest_vectors,
        op11_importance_resampling, op12_lexical_search, op13_personal_data,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_source_mixing": mixing.MIX_SQL,
    "op11_importance_resampling": resampling.RESAMPLE_SQL,
    "op12_lexical_search": lexical.SEARCH_SQL,
}

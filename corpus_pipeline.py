"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

toxicity -> near_dedup -> passage_dedup -> mixing -> packing. All but the last return the columns of
``documents``; the last returns the packed pieces. Null or empty texts, repeated rows, empty tables
and further columns pass as each operator's own module defines.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from stakeflow.llm import minhash, mixing, packing, passages, toxicity
from stakeflow.llm.storage import written
from stakeflow.session import configure
from stakeflow.sources import Tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples' votes call toxic go."""
    return toxicity.drop_toxic(docs, Tables(configure(spark), sf_dir).labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    configure(spark)
    return minhash.drop_near_copies(docs, minhash.Settings(shingle=5, similarity=Fraction(8, 10)))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut from the later ones."""
    configure(spark)
    return passages.cut_passages(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in the order of the mix."""
    configure(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix, tokenized and packed into sequences of 2048 tokens.

    A document that the mix takes twice is packed twice; sequence and offset tell its appearances apart.
    """
    configure(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Sketches, votes and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole pipeline over ``documents``."""
    docs = Tables(configure(spark), sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

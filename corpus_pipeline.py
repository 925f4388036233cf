"""A corpus pipeline of five stages; each reads what the one before it wrote.

Counted as part of ``framequorum.llm``: without that subpackage this module does not import.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framequorum.llm import langid, mixing, pieces, repeats, simhash
from framequorum.llm.common import keep

#: Words of a shingle and least similarity of near copies.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; the others go."""
    return langid.accepted_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)


def without_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of long strings that start earlier in the corpus; n_chars follows the text."""
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture of their sources uses them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every remaining text, and whether they decode to it."""
    return pieces.encode_texts(docs)


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_dedup", without_repeated_bytes),
    ("source_mixing", mixed),
    ("sentencepiece", encoded),
]

#: Fingerprints, trained trigrams, suffix sorting and piece ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

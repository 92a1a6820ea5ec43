"""A training-data pipeline of five stages over ``documents``; it belongs to the subpackage ``tidewatch.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import jaccard, langid, mixing, packing, substrings
from tidewatch.llm.common import forget, importable, stored, table
from tidewatch.llm.queries import TOKENIZER


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null ones among them, and those far from every learned language; repeated rows go or stay together."""
    importable(spark)
    return langid.with_language(docs, langid.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group linked by a likeness of 0.8 on five-word shingles.

    Of rows with one id the first by the hash of its text stays, once; all rows without an id stay.  Null texts
    and those without a word are copies of each other.
    """
    importable(spark)
    return jaccard.near_dedup(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated windows of words out of the texts; documents that thereby keep no word go, others, null ones too, stay as they are."""
    importable(spark)
    return substrings.dedup_substrings(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out and repeats documents so that the sources' words come near their targets; null sources are one, the last."""
    importable(spark)
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences; a row for each piece of a document, of repeated rows as often, of a null text its end id."""
    importable(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language id", identify_language),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The trained and iterative stages have no SQL; tests/llm holds them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: language ID, exact dedup, near dedup, mixing and packing over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but
the last return the columns of documents. A row that repeats after mixing is a repetition that
the mix takes, and is packed as a row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language, mixing, near_copies, packing
from tessera.llm.common import durable, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the rest are rejected."""
    return language.keep_identified(docs, language.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that op8's SimHash fingerprints link, or whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_copies.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]

#: Language ID, near copies and packing are not for SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, f"stage-{k}")
    return docs

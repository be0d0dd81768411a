"""Which texts say a term, and how often: a table written once, in partitions of terms and years."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.lineage import _remove, shared_base

#: Partitions of terms.
TERM_PARTS = 8


def term_part(term: Column, parts: int = TERM_PARTS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def counted_terms(docs: DataFrame, keys: Sequence[str], body: str, least: int = 3) -> DataFrame:
    """(keys, term, n): the terms of each text, as functions.text.tokens makes them, with how often they stand in it as words."""
    words = F.concat(text.find_all(F.col(body), "[가-힣]{2,}"), F.transform(text.find_all(F.col(body), f"[A-Za-z]{{{least},}}"), F.lower))
    return docs.select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def write_postings(docs: DataFrame, keys: Sequence[str], body: str, at: str, parts: int = TERM_PARTS, path: str | None = None) -> DataFrame:
    """(keys, at, term, n, part, year) of docs, written under path (else the shared folder, until the process ends) by part of the term and year of ``at``.

    A reader that joins on part and term reads only the partitions that its terms fall in. Texts without a date are of year 0.
    """
    spark, kept = docs.sparkSession, path is not None
    path = path or f"{shared_base(spark)}/postings-{uuid.uuid4().hex}"
    rows = counted_terms(docs, [*keys, at], body).withColumns({"part": term_part(F.col("term"), parts), "year": F.coalesce(F.year(at), F.lit(0))})
    rows.repartition("part", "year").write.partitionBy("part", "year").mode("overwrite").parquet(path)
    if not kept:
        atexit.register(_remove, spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def first_keywords(c: Column, most: int = 5) -> Column:
    """The first of a text's terms in their order, most of them at most."""
    return F.slice(F.array_sort(text.tokens(c, 3)), 1, most)


def past_mentions(keywords: DataFrame, postings: DataFrame, id_: str, group: str, doc: str, at: str, excluded: str) -> DataFrame:
    """(id_, keyword, docs, mentions, since): in which texts of its group each keyword stands, those of ``excluded`` (an array of doc ids) left out.

    keywords: id_, group, keyword, excluded. A keyword that stands in none has no row.
    """
    asked = keywords.select(id_, group, "keyword", excluded, term_part(F.col("keyword")).alias("part"))
    met = asked.withColumn("term", F.col("keyword")).join(postings, ["part", "term", group]).filter(~F.coalesce(F.array_contains(excluded, F.col(doc)), F.lit(False)))
    return met.groupBy(id_, "keyword").agg(F.count("*").alias("docs"), F.sum("n").alias("mentions"), F.min(at).alias("since"))

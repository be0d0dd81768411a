"""Exact deduplication by skew-safe combining (DataFrame operations only).

Copies are combined three times, and the whole text is a grouping key each time, so
unequal texts never merge even if their digests do:

1. locally, by the partial aggregation in front of the first shuffle;
2. per (digest, salt, text), which spreads a group of any size over ``salts`` tasks, by default
   one for each ``SALT_ROWS`` rows of the table;
3. per (digest, text) over the salt winners, at most ``salts`` rows a text.

Answers go back the same way: a text's winner is spread to its (digest, salt) groups, and rows meet
it there, so that no key of the last join has more rows than a salt.

Behaviour: null text counts as the empty text. Null doc_ids lose to any other; a group of
only null ids keeps all of its rows. Rows that repeat one doc_id (not null) and text are one
document: all get the same answer, and ``deduplicate`` returns one of them. An empty table gives an
empty result. Other columns are not read by ``duplicate_report`` and pass unchanged through
``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, table, text_or_empty

#: Rows of the table for each salt, and salts at least.
SALT_ROWS, LEAST_SALTS = 1_000_000, 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _salt(salts: int) -> Column:
    return F.pmod(F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(F.hash("doc_id")), F.lit(salts))


def _classes(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text) -> keep_id, group_size."""
    salted = (
        rows.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _answered(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with salt) joined with their class by keys and salt: the class is first spread to the salts that it has."""
    spread = rows.select(*keys, "salt").distinct().join(classes, keys)
    return rows.join(spread, [*keys, "salt"])


def duplicate_report(docs: DataFrame, salts: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of docs."""
    salts = salts or max(LEAST_SALTS, docs.count() // SALT_ROWS)
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", digest(F.col("text")))
    per_digest = durable(
        _classes(rows, salts)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "exact-classes",
    )
    light = durable(rows.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256"), _salt(salts).alias("salt")), "exact-rows")
    found = _answered(light, per_digest.filter("n_texts = 1").drop("n_texts"), ["digest"])
    clash = per_digest.filter("n_texts > 1").select("digest")
    if not clash.isEmpty():  # unequal texts under one digest: match those on the text itself
        torn = durable(rows.join(clash, "digest", "left_semi").withColumn("salt", _salt(salts)), "exact-torn")
        exact = _answered(torn, _classes(torn, salts), ["digest", "text"])
        found = found.unionByName(exact.select("digest", "salt", "doc_id", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = duplicate_report(docs, salts).filter("kept").select("doc_id", "text_sha256").distinct()
    marked = docs.withColumns({"_tessera_id": F.col("doc_id"), "_tessera_sha": F.sha2(text_or_empty(), 256)})
    keep = kept.select(F.col("doc_id").alias("_tessera_keep_id"), F.col("text_sha256").alias("_tessera_keep_sha"))
    out = marked.join(keep, F.col("_tessera_id").eqNullSafe(F.col("_tessera_keep_id")) & (F.col("_tessera_sha") == F.col("_tessera_keep_sha")), "left_semi")
    repeats = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if not repeats.isEmpty():
        out = out.filter("_tessera_id IS NOT NULL").dropDuplicates(["_tessera_id", "_tessera_sha"]).unionAll(out.filter("_tessera_id IS NULL"))
    return out.drop("_tessera_id", "_tessera_sha")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(table(spark, sf_dir, "documents"))


SQL = {
    "op10_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""
}

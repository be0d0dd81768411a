"""Term statistics over texts: BM25 and TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.lineage import cut


def _counts(docs: DataFrame, key: str, pattern: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))
    return docs.select(key, F.explode(words).alias("w")).groupBy(key, "w").agg(F.count("*").alias("f"))


def bm25(docs: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score of documents that hold any of the terms, runs of a-z. Texts are counted in place: only hits are shuffled."""

    def count(term: str):
        return F.struct(F.lit(term).alias("term"), F.regexp_count(F.lower("text"), F.lit(f"(?<![a-z]){term}(?![a-z])")).alias("tf"))

    # written once: statistics and hits both read these few numbers a text
    rows = cut(docs.select("doc_id", F.regexp_count(F.lower("text"), F.lit("[a-z]+")).alias("dl"), F.array(*map(count, terms)).alias("tf")))
    stats = rows.filter("dl > 0").agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    hits = rows.select("doc_id", "dl", F.inline("tf")).filter("tf > 0")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
    joined = hits.join(F.broadcast(df), "term").join(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("doc_id").agg(F.sum(part).alias("score"))


def tfidf(docs: DataFrame, key: str, pattern: str = "[a-z]{4,}") -> DataFrame:
    """key, w, score: term frequency within a key times ln(keys / (1 + keys with the term))."""
    counts = cut(_counts(docs, key, pattern))  # texts are split once; what follows reads a row a key and word
    df = counts.groupBy("w").agg(F.count("*").alias("df"))
    totals = counts.groupBy(key).agg(F.sum("f").alias("total"))
    keys = totals.agg(F.count("*").alias("keys"))  # one row
    rows = counts.join(df, "w").join(totals, key).join(F.broadcast(keys))
    return rows.select(key, "w", (F.col("f") / F.col("total") * F.log(F.col("keys") / (1 + F.col("df")))).alias("score"))


def phrase_search(docs: DataFrame, phrase: str, reach: int = 75) -> DataFrame:
    """doc_id, n, snippet of documents that hold the phrase in any case: how often, and the text around its first place."""
    hits = docs.filter(F.contains(F.lower("text"), F.lit(phrase.lower())))
    return hits.select("doc_id", text.count_of(F.lower("text"), phrase.lower()).cast("long").alias("n"), text.window_around(F.col("text"), phrase, reach).alias("snippet"))

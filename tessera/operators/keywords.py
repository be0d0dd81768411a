"""Many keywords and ordered rules over texts and names, each text read once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = "map<string,int>"


def keyword_counts(keywords: Sequence[str]):
    """A function of a text column: how often each keyword occurs, in any case; only those that do.

    Occurrences of one keyword don't overlap; those of different keywords may. One automaton finds all keywords in one pass, so hundreds
    cost little more than a few. Null text has none; empty keywords are left out.
    """
    words = {k.lower(): None for k in keywords if k}
    shown: dict[str, list[str]] = {w: [k for k in dict.fromkeys(keywords) if k and k.lower() == w] for w in words}

    @F.pandas_udf(COUNTS)
    def count(texts: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        if words:
            automaton.make_automaton()

        def of(text: str | None) -> dict[str, int]:
            counts: dict[str, int] = {}
            free: dict[str, int] = {}  # where the last counted occurrence of a keyword ends
            for end, w in automaton.iter(text.lower()) if text and words else ():
                if end - len(w) + 1 >= free.get(w, 0):
                    counts[w] = counts.get(w, 0) + 1
                    free[w] = end + 1
            return {k: n for w, n in counts.items() for k in shown[w]}

        return texts.map(of)

    return count


def tags(texts: DataFrame, keys: Sequence[str], sector: str, full: str, core: str, taxonomy: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(keys, axis, category, n, confidence, matched): categories of a company's sector whose keywords its text names.

    taxonomy: (sector, axis, category, keyword). Five mentions, one of them in the core text, are HIGH; five, or two with one in the core, MEDIUM.
    """
    count = keyword_counts([k for *_, k in taxonomy])
    spark = texts.sparkSession
    rules = spark.createDataFrame(list(taxonomy), "sector string, axis string, category string, keyword string")
    rules = rules.groupBy("sector", "axis", "category").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    rows = texts.select(*keys, F.col(sector).alias("sector"), F.inline(F.array(F.struct(count(F.col(full)).alias("in_full"), count(F.col(core)).alias("in_core")))))
    rows = rows.join(rules, "sector")
    of = lambda m: F.aggregate("keywords", F.lit(0), lambda a, k: a + F.coalesce(F.col(m)[k], F.lit(0)))
    rows = rows.select(*keys, "axis", "category", of("in_full").alias("n"), (of("in_core") > 0).alias("core"), F.slice(F.filter("keywords", lambda k: F.col("in_full")[k].isNotNull()), 1, 10).alias("matched")).filter("n > 0")
    confidence = F.when((F.col("n") >= 5) & F.col("core"), "HIGH").when((F.col("n") >= 5) | ((F.col("n") >= 2) & F.col("core")), "MEDIUM").otherwise("LOW")
    return rows.select(*keys, "axis", "category", "n", confidence.alias("confidence"), "matched")


def sector_of(names: DataFrame, name: str, exact: Mapping[str, str], patterns: Sequence[tuple[str, str]], fallback: Column, otherwise: str, least: int = 4) -> DataFrame:
    """names with a column sector: by the exact name, else the first pattern (in any case), else the first listed name of ``least``
    characters or more that it begins with, else the fallback, else otherwise. A null or empty name is of ``otherwise``.
    """
    c = F.col(name)
    listed = F.create_map(*[F.lit(x) for pair in exact.items() for x in pair]) if exact else F.create_map().cast("map<string,string>")
    by_pattern = [F.when(c.rlike(f"(?i){p}"), s) for p, s in patterns]
    begins = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in exact.items() if len(k) >= least]).cast("array<struct<k:string,s:string>>")
    by_prefix = F.get(F.filter(begins, lambda b: F.startswith(c, b["k"])), F.lit(0))["s"]
    return names.withColumn("sector", F.when(F.coalesce(c, F.lit("")) == "", otherwise).otherwise(F.coalesce(listed[c], *by_pattern, by_prefix, fallback, F.lit(otherwise))))


def weighted_sector(head: Column, body: Column, text: Column, sectors: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The sector whose keywords weigh most: 3 in the head, 2 in the body, 1 in the text; of equals the first listed; without any, otherwise."""
    said = lambda c, words: sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))
    scores = F.array(*[F.struct((said(head, ws) * 3 + said(body, ws) * 2 + said(text, ws)).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, (s, ws) in enumerate(sectors)])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["s"]).otherwise(otherwise)

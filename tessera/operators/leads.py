"""Rule-driven lead detection, novelty, source matching and related companies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators.lineage import cut
from tessera.operators.relational import top_per_key

#: Rules that are sent to the tasks, at most. Ids of a range whose sums are taken first.
MOST_RULES, RANGE = 10_000, 4_096


def _once(**columns: Column) -> Column:
    """Columns made by a generator, so that they are computed once and not again in every filter above."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def detect(docs: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leads of texts: rules whose keywords occur, with evidence long enough, no exclusion in it and wanted context.

    rules: rule_code, lead_type, severity, keywords, excluded, context, least. A text gives a
    lead of each type at most, by the first rule. Rules are sent to the texts, MOST_RULES at most.
    """
    if rules.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    has = lambda c, words: F.filter(words, lambda w: F.contains(c, w))
    every = rules.agg(F.collect_list(F.struct(*rules.columns)).alias("rules"))  # one row
    parts = F.transform(text.sentences(F.col("text")), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    rows = docs.select(key, "source", _once(body=F.lower("text"), parts=parts)).join(F.broadcast(every))
    rows = rows.select(key, "source", "body", "parts", F.inline(F.filter("rules", lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("body"), k)))))
    rows = rows.filter((F.size("context") == 0) | F.exists("context", lambda w: F.contains(F.col("body"), w)))
    kept = [key, "source", "parts", "rule_code", "lead_type", "severity", "excluded", "least"]
    rows = rows.select(*kept, _once(keywords=has(F.col("body"), F.col("keywords")))).withColumn("word", F.lower(F.get("keywords", F.lit(0))))
    found = F.transform(F.filter("parts", lambda p: F.contains(p["low"], F.col("word"))), lambda p: p["s"])
    rows = rows.select(*[c for c in kept if c != "parts"], "keywords", _once(evidence=F.substring(F.array_join(found, ". "), 1, 300)))
    rows = rows.filter((F.length("evidence") >= F.col("least")) & ~F.exists("excluded", lambda w: F.contains(F.lower("evidence"), w)))
    first = F.min_by(F.struct("source", "rule_code", "severity", "keywords", "evidence"), "rule_code").alias("l")
    return rows.groupBy(key, "lead_type").agg(first).select(key, "l.source", "lead_type", "l.rule_code", "l.severity", "l.keywords", "l.evidence")


def evidence_unique(evidence: Column, past: Column) -> Column:
    """The per cent of evidence's ten longest words that past lacks; 60 if it has no word."""
    return text.once(longest_words(evidence), lambda words: unique_share(words, past))


def longest_words(evidence: Column, most: int = 10) -> Column:
    """Different words of four letters or more, the longest first."""
    words = F.array_distinct(text.find_all(evidence, "[A-Za-z]{4,}"))
    return F.transform(F.slice(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), 1, most), lambda x: x["w"])


def unique_share(words: Column, past: Column) -> Column:
    """The per cent of words that past lacks, which is written once and not once a word; 60 without words."""
    missing = text.once(past, lambda past: F.size(F.filter(words, lambda w: ~F.contains(past, F.lower(w)))))
    return F.when(F.size(words) == 0, 60).otherwise(F.floor(F.try_divide(missing * 100, F.size(words)))).cast("int")


def novelty(docs: DataFrame, fresh: Sequence[str], gone: Sequence[str], evidence: Column, past_text: Column) -> DataFrame:
    """How new a text is to its source: key words against those of earlier texts (40 %), how much it says so (30 %), new evidence (30 %).

    What stands earlier is summed by ranges of RANGE doc_ids first, so no task holds all texts of a source.
    """
    rows = docs.select("doc_id", "source", text.hits(F.col("text"), fresh).alias("fresh"), text.hits(F.col("text"), gone).alias("gone"), evidence_unique(evidence, past_text).alias("ev"))
    rows = cut(rows.withColumn("part", F.floor(F.col("doc_id") / RANGE)))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("source", "part").agg(F.sum("fresh").alias("words")).withColumn("earlier", F.sum("words").over(before)).drop("words")
    within = Window.partitionBy("source", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    rows = rows.withColumn("near", zero(F.sum("fresh").over(within))).join(ranges.select(F.col("source").alias("of"), F.col("part").alias("of_part"), "earlier"), same)
    rows = rows.withColumn("past", F.col("near") + zero(F.col("earlier")))
    total = F.col("fresh") + F.col("gone")
    said = F.when(total >= 5, 95).when(total >= 3, 80).when(total >= 1, 65).otherwise(30)
    now = F.col("fresh") > 0
    words = F.when(now & (F.col("past") == 0), 95).when(now & (F.col("fresh") > 5), 70).when(now, 30).when(F.col("past") > 0, 85).otherwise(50)
    return rows.select("doc_id", words.alias("kw"), said.alias("ai"), "ev", (words * 0.4 + said * 0.3 + F.col("ev") * 0.3).cast("int").alias("score"))


def match_score(rows: DataFrame, today: Column) -> DataFrame:
    """matched and score of (keywords, shown text, weight, published_at): half keywords, the rest outlet and recency. Without keywords none are matched."""
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    rows = rows.withColumn("matched", F.filter(words, lambda k: F.contains(F.col("shown"), k)))
    share = F.size("matched").cast("double") / F.greatest(F.lit(1), F.size(words))
    return rows.withColumn("score", F.round(share * 0.5 + F.col("weight") * 0.3 + numbers.recency(F.col("published_at"), today) * 0.2, 3))


def decide(tier: Column, score: Column) -> Column:
    """PASS, PARTIAL or FAIL of a citation by its outlet's tier and its cross-check score."""
    steps = lambda high, low: F.when(score >= high, "PASS").when(score >= low, "PARTIAL").otherwise("FAIL")
    weak = F.when(score >= 80, "PARTIAL").otherwise("FAIL")
    return F.when(tier == "T1", steps(70, 50)).when(tier == "T2", steps(80, 60)).when(tier.isin("T3", "UNKNOWN"), weak).otherwise("FAIL")


def flag(rows: DataFrame, score: str) -> DataFrame:
    s = F.col(score)
    return rows.withColumn("flag", F.when(s >= 80, "SAFE").when(s >= 65, "LOW").when(s >= 50, "MEDIUM").otherwise("HIGH"))


def related_companies(news: DataFrame, edges: DataFrame, companies: DataFrame, sector_words: Mapping[str, Sequence[str]], never: Sequence[str], sectors: int = 3, most: int = 20) -> DataFrame:
    """The ``most`` companies that each news (id, named, words; a row a news) concerns: named 100, in the supply chain 60, else of its leading sectors 30.

    Who names a company scores the same, and so do the companies of a sector. So only the first ``most`` names of either (one more of the
    namers, as one may be named itself) are held against the news: whoever comes after them stands behind them.
    """
    own = companies.filter(~F.col("sector").isin(*never)).select("corp_code", "corp_name", "sector")
    direct = news.select("id", F.col("named").alias("corp_code"), F.lit(100).alias("score"), F.lit("direct").alias("reason"))
    namers = edges.select(F.col("partner_id").alias("named"), "corp_code").distinct().join(own.select("corp_code", "corp_name"), "corp_code")
    namers = top_per_key(namers, ["named"], most + 1, F.col("corp_name"), F.col("corp_code")).select("named", "corp_code")
    chain = news.select("id", "named").join(namers, "named").filter("corp_code <> named")
    known = direct.unionByName(chain.select("id", "corp_code", F.lit(60).alias("score"), F.lit("supply chain").alias("reason")))
    hits = lambda words: sum((F.size(F.filter("words", lambda x: F.contains(x, F.lit(w)) | F.contains(F.lit(w), x))) for w in words), F.lit(0))
    said = F.array(*[F.struct((-hits(words)).alias("n"), F.lit(s).alias("sector")) for s, words in sector_words.items() if s not in never])
    leading = F.slice(F.array_sort(F.filter(said, lambda s: s["n"] < 0)), 1, sectors)
    first = top_per_key(own, ["sector"], most, F.col("corp_name"), F.col("corp_code")).select("sector", "corp_code")
    peers = news.select("id", F.explode(leading).alias("s")).select("id", "s.sector").join(first, "sector").join(known.select("id", "corp_code"), ["id", "corp_code"], "left_anti")
    every = known.unionByName(peers.select("id", "corp_code", F.lit(30).alias("score"), F.lit("sector").alias("reason")))
    summed = every.groupBy("id", "corp_code").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list("reason")).alias("reasons")).join(own.drop("sector"), "corp_code")
    return top_per_key(summed, ["id"], most, F.desc("score"), F.col("corp_name"), F.col("corp_code")).select("id", "corp_code", "score", "reasons", "rank")

"""Checks of articles against their sources: numbers, direction, evidence, grounding, and what they add up to."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators.relational import top_per_key

# Words that say up and down, and words too common to prove anything.
UP = ["증가", "급증", "상승", "확대", "흑자", "개선", "성장", "호조", "회복"]
DOWN = ["감소", "급감", "하락", "축소", "적자", "악화", "둔화", "부진", "추락", "곤두박질"]
COMMON = ["있다", "있음", "있는", "있어", "있으며", "회사", "당사", "기업", "사업", "보고서", "공시", "기준", "비교", "변화", "분석", "내용", "관련"]

FIGURES = ["revenue", "operating_income", "net_income", "total_assets", "total_liabilities", "total_equity", "cash", "inventory"]
RATIOS = {
    "debt_ratio": ("total_liabilities", "total_equity"), "current_ratio": ("current_assets", "current_liabilities"), "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"), "roe": ("net_income", "total_equity"), "roa": ("net_income", "total_assets"),
}


def truth(financials: DataFrame, years: int = 5) -> DataFrame:
    """(corp_code, amounts, ratios, last): figures and ratios in per cent of a company's last years, and its last two years' results, latest first."""
    rows = top_per_key(financials, ["corp_code"], years, F.desc("fiscal_year"), rank="k")
    figures = F.filter(F.array(*[F.col(c).cast("double") for c in FIGURES]), lambda v: v.isNotNull() & (v != 0))
    shares = F.filter(F.array(*[numbers.per_cent(F.col(a), F.col(b)) for a, b in RATIOS.values()]), lambda v: v.isNotNull())
    year = F.struct("k", figures.alias("amounts"), shares.alias("ratios"), F.struct("revenue", "operating_income", "net_income").alias("results"))
    held = rows.groupBy("corp_code").agg(F.array_sort(F.collect_list(year)).alias("y"))  # years a company
    return held.select("corp_code", F.flatten("y.amounts").alias("amounts"), F.flatten("y.ratios").alias("ratios"), F.slice("y.results", 1, 2).alias("last"))


def share(part: Column, whole: Column, factor: int = 100) -> Column:
    """part of whole times factor, cut to 100 and to a whole number; null if whole is 0."""
    return F.least(F.try_divide(part.cast("double"), whole) * factor, F.lit(100.0)).cast("int")


def numeric_score(found: Column, amounts: Column, ratios: Column) -> Column:
    """The per cent of lexed numbers that agree with a value of either kind; 50 if there are no values, 70 if there are no numbers."""
    agreed = lambda found: text.once(F.concat(amounts, ratios), lambda pool: F.size(F.filter(found, lambda x: F.exists(pool, lambda v: numbers.agrees(x["value"], x["per_cent"], v)))))
    return text.once(found, lambda found: F.when(amounts.isNull(), 50).when(F.size(found) == 0, 70).otherwise(share(agreed(found), F.size(found))))


def moved(now: Column, then: Column) -> Column:
    """up, down or flat, flat within 2 %; null if either is missing."""
    rate = F.try_divide((now - then).cast("double"), F.abs(then))
    from_zero = F.when(now > 0, "up").when(now < 0, "down").otherwise("flat")
    return F.when(now.isNull() | then.isNull(), None).when(then == 0, from_zero).when(rate > 0.02, "up").when(rate < -0.02, "down").otherwise("flat")


def direction_score(body: Column, last: Column, up: Sequence[str] = UP, down: Sequence[str] = DOWN) -> Column:
    """100 if the words agree with how the result moved (operating income, else net income, else revenue), 30 if not, 75 if they are mixed, 70 without two years."""
    said = lambda body, words: sum((text.count_of(body, w) for w in words), F.lit(0))
    says = lambda n: F.when(n["ups"] > n["downs"] * 1.3, "up").when(n["downs"] > n["ups"] * 1.3, "down").otherwise("mixed")
    counts = text.once(body, lambda body: F.struct(said(body, up).alias("ups"), said(body, down).alias("downs")))
    now, then = F.get(last, F.lit(0)), F.get(last, F.lit(1))
    actual = F.coalesce(*[moved(now[c], then[c]) for c in ("operating_income", "net_income", "revenue")])
    score = lambda x: F.when(F.coalesce(F.size(last), F.lit(0)) < 2, 70).when(x["actual"].isNull(), 70).when(x["says"] == "mixed", 75).when(x["says"] == x["actual"], 100).otherwise(30)
    return text.once(text.once(counts, lambda n: F.struct(says(n).alias("says"), actual.alias("actual"))), score)


def evidence_score(body: Column, evidence: Column, common: Sequence[str] = COMMON) -> Column:
    """How many of the evidence's words the body has, half of them counting as all; 70 for evidence under 30 characters or without words."""
    met = lambda words: F.size(F.array_intersect(words, text.tokens(body, 3)))
    score = lambda words: F.when(evidence.isNull() | (F.length(evidence) < 30) | (F.size(words) == 0), 70).otherwise(share(met(words), F.size(words), 200))
    return text.once(text.tokens(evidence, 3, common), score)


def grounding_score(body: Column, source: Column, common: Sequence[str] = COMMON) -> Column:
    """How many of the body's words of four characters or more the source has; 80 if the body has none."""
    met = lambda words: F.size(F.array_intersect(words, text.tokens(source, 3)))
    score = lambda words: F.when(F.size(words) == 0, 80).otherwise(share(met(words), F.size(words), 120))
    return text.once(F.filter(text.tokens(body, 3, common), lambda w: F.length(w) >= 4), score)


def total(numeric: Column, direction: Column, evidence: Column, grounding: Column) -> Column:
    return (numeric * 0.30 + direction * 0.25 + evidence * 0.25 + grounding * 0.20).cast("int")


def cross_check(cited: Column, amounts: Column, ratios: Column, source: Column) -> Column:
    """.6 of how many numbers agree (percentages with ratios within 2 points, amounts within 5 % of large figures) and .4 of how many nouns the source contains."""
    none = F.array().cast("array<double>")
    near = lambda v: F.exists(F.coalesce(amounts, none), lambda a: (a > numbers.LARGE) & (F.try_divide(F.abs(a - v), F.greatest(a, v)) <= numbers.NEAR))
    points = lambda v: F.exists(F.coalesce(ratios, none), lambda r: F.abs(r - v) <= numbers.POINTS)
    agreed = lambda found: F.size(F.filter(found, lambda x: F.when(x["per_cent"], points(x["value"])).otherwise((x["value"] > 0) & near(x["value"]))))
    numeric = text.once(numbers.lex(cited), lambda found: F.when(F.size(found) == 0, 100).otherwise(share(agreed(found), F.size(found))))
    nouns = F.array_distinct(F.concat(text.find_all(cited, "[가-힣]{3,}"), F.transform(text.find_all(cited, "[A-Za-z]{4,}"), F.lower)))
    held = lambda nouns: text.once(F.lower(source), lambda low: F.size(F.filter(nouns, lambda w: F.contains(low, w))))
    cover = text.once(nouns, lambda nouns: F.when(F.size(nouns) == 0, 100.0).otherwise(F.try_divide(held(nouns).cast("double"), F.size(nouns)) * 100))
    return (numeric * 0.6 + cover * 0.4).cast("int")


def postprocess_score(body: Column, headline: Column, speculation: Column, numbers_: Column, known: Column) -> Column:
    """100 less half of what the headline's words lack in the body, 8 for each uncited speculation, 3 for each uncited number from the fifth on, and half of what known words (per cent) lack to 60; 0 for an empty body."""
    counted = F.when(numbers_ >= 5, (numbers_ - 4) * 3).otherwise(0)
    score = 100 - F.floor((100 - headline) / 2) - speculation * 8 - counted - F.greatest(F.lit(0), F.floor((60 - known) / 2))
    return F.when(F.coalesce(body, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("int")


#: Width of a bucket of logarithms: amounts within 5 % of the greater are in one or in neighbours.
_WIDTH = -math.log(1 - numbers.NEAR) * 1.000001


def tolerance_matches(found: DataFrame, values: DataFrame, keys: Sequence[str], id_: str) -> DataFrame:
    """id_ of each row of found (id_, keys, value, per_cent) that agrees with a value (keys, truth) of its keys, once.

    A band join: percentages meet truths by buckets of 2 points, large amounts by buckets of the logarithm, each with
    both neighbours, and others by equality; what meets is compared exactly. No number meets all truths.
    """
    step = lambda c: F.floor(c / numbers.POINTS)
    grade = lambda c: F.floor(F.log(c) / _WIDTH)
    cell = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("double").alias("at"))
    around = lambda kind, at: [cell(kind, at + k) for k in (-1, 0, 1)]
    v, t = F.col("value"), F.col("truth")
    asked = F.when(F.col("per_cent"), F.array(*around("points", step(v)))).when(v > numbers.LARGE, F.array(*around("large", grade(v)), cell("same", v))).otherwise(F.array(cell("same", v)))
    held = F.when(t > numbers.LARGE, F.array(cell("points", step(t)), cell("large", grade(t)), cell("same", t))).otherwise(F.array(cell("points", step(t)), cell("same", t)))
    left = found.filter(v.isNotNull()).select(id_, *keys, "value", "per_cent", F.inline(asked))
    right = values.filter(t.isNotNull()).select(*keys, "truth", F.inline(held)).distinct()
    met = left.join(right, [*keys, "kind", "at"])
    return met.filter(numbers.agrees(v, F.col("per_cent"), t)).select(id_).distinct()


def agreeing(found: Column, truth: Column, large: Column) -> Column:
    """How many of the lexed numbers agree with one of truth, whose values above a million are given as large, too; none of null."""
    points = lambda v: F.exists(truth, lambda t: F.abs(t - v) <= numbers.POINTS)
    near = lambda v: F.exists(large, lambda t: F.try_divide(F.abs(t - v), F.greatest(t, v)) <= numbers.NEAR)
    agrees = lambda x: F.when(x["per_cent"], points(x["value"])).when(x["value"] > numbers.LARGE, near(x["value"])).otherwise(F.array_contains(truth, x["value"]))
    return F.when(truth.isNull(), 0).otherwise(F.size(F.filter(found, agrees)))

"""Numeric functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_amount(c: Column) -> Column:
    """'(1,234)' is -1234; blanks and dashes are null."""
    bare = F.regexp_replace(F.trim(c), "[, ]", "")
    negative = bare.rlike(r"^\(.*\)$")
    value = F.regexp_replace(bare, "[()]", "").try_cast("double")
    return F.when(negative, -value).otherwise(value)


UNITS = {"trillion": 1e12, "billion": 1e9, "million": 1e6, "thousand": 1e3}


def parse_unit(c: Column) -> Column:
    """A number with its unit word, as a number."""
    number = F.replace(F.regexp_extract(c, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
    word = F.lower(F.regexp_extract(c, "(?i)(trillion|billion|million|thousand)", 1))
    factor = F.lit(1.0)
    for unit, value in UNITS.items():
        factor = F.when(word == unit, value).otherwise(factor)
    return number * factor


def ladder(c: Column, steps: Sequence[tuple[float, int]], above: int) -> Column:
    """The score of the first step that c does not exceed."""
    out = F.lit(above)
    for limit, score in reversed(steps):
        out = F.when(c <= limit, score).otherwise(out)
    return out


def ladder_sql(c: str, steps: Sequence[tuple[float, int]], above: int) -> str:
    return "CASE " + " ".join(f"WHEN {c} <= {limit} THEN {score}" for limit, score in steps) + f" ELSE {above} END"


def per_cent(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")) * 100, digits)


def recency(c: Column, today: Column) -> Column:
    """By age in days, a coming date like a past one; unknown is old."""
    age = F.abs(F.datediff(today, c))
    return F.when(age <= 30, 1.0).when(age <= 60, 0.85).when(age <= 90, 0.7).when(age <= 180, 0.5).otherwise(0.3)


# Unit words of amounts and what they stand for.
UNIT_WORDS = {"조": 1e12, "억": 1e8, "천만": 1e7, "백만": 1e6, "만": 1e4}
AMOUNT = r"[0-9][0-9,]*\.?[0-9]*\s*(?:" + "|".join(UNIT_WORDS) + ")"
PER_CENT = r"[+-]?[0-9.,]+\s*%"
#: What a number and its unit consist of beside the unit's word, so that characters part them without a pattern.
NUMERIC, BLANKS = "0123456789.,", " \t\n\x0b\f\r"
LEXED = "array<struct<raw:string,value:double,per_cent:boolean>>"


def lex(c: Column) -> Column:
    """Amounts with a unit word, then percentages with their sign, as (raw, value, per_cent); what is no number is left out."""
    word = lambda raw: F.translate(raw, NUMERIC + BLANKS, "")
    factors = F.create_map(*[F.lit(x) for pair in UNIT_WORDS.items() for x in pair])
    bare = lambda raw, rest: F.translate(raw, "," + BLANKS + rest, "").try_cast("double")
    amounts = F.transform(F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0)), lambda r: F.struct(r.alias("raw"), (bare(r, "".join(UNIT_WORDS)) * factors[word(r)]).alias("value"), F.lit(False).alias("per_cent")))
    shares = F.transform(F.regexp_extract_all(c, F.lit(PER_CENT), F.lit(0)), lambda r: F.struct(r.alias("raw"), bare(r, "%").alias("value"), F.lit(True).alias("per_cent")))
    return F.filter(F.concat(amounts.cast(LEXED), shares.cast(LEXED)), lambda x: x["value"].isNotNull())


LARGE, NEAR, POINTS = 1e6, 0.05, 2.0


def agrees(value: Column, per_cent: Column, truth: Column) -> Column:
    """A percentage within 2 points; amounts within 5 % of the greater if both are above a million, else equal."""
    large = (value > LARGE) & (truth > LARGE)
    near = F.when(large, F.try_divide(F.abs(truth - value), F.greatest(truth, value)) <= NEAR).otherwise(truth == value)
    return F.when(per_cent, F.abs(truth - value) <= POINTS).otherwise(near)


def agrees_sql(value: str, per_cent: str, truth: str) -> str:
    return f"CASE WHEN {per_cent} THEN abs({truth} - {value}) <= 2.0 WHEN {value} > 1e6 AND {truth} > 1e6 THEN abs({truth} - {value}) / greatest({truth}, {value}) <= 0.05::DOUBLE ELSE {truth} = {value} END"


def lex_sql(c: str) -> str:
    """lex in another engine's SQL."""
    units = "|".join(UNIT_WORDS)
    factor = "CASE " + " ".join(f"WHEN r LIKE '%{u}' THEN {int(f)}::DOUBLE" for u, f in sorted(UNIT_WORDS.items(), key=lambda x: -len(x[0]))) + " END"
    amounts = f"list_transform(regexp_extract_all({c}, '{AMOUNT}'), lambda r: {{'raw': r, 'value': try_cast(regexp_replace(r, '[,\\s]|{units}', '', 'g') AS DOUBLE) * {factor}, 'per_cent': false}})"
    shares = f"list_transform(regexp_extract_all({c}, '{PER_CENT}'), lambda r: {{'raw': r, 'value': try_cast(regexp_replace(r, '[,\\s]|%', '', 'g') AS DOUBLE), 'per_cent': true}})"
    return f"list_filter(list_concat({amounts}, {shares}), lambda x: x.value IS NOT NULL)"


def weighted_int(*parts: tuple[Column, float]) -> Column:
    """The weighted sum, cut towards zero to a whole number."""
    total = None
    for value, weight in parts:
        total = value * weight if total is None else total + value * weight
    return total.cast("int")


def fmt_amount(c: Column) -> Column:
    """An amount in 억 (1e8), from 10,000 of them on in 조 with one decimal; N/A for null."""
    hundred_millions = c / 1e8
    wide = F.abs(hundred_millions) >= 10000
    shown = F.when(wide, F.format_string("%,.1f조", hundred_millions / 10000)).otherwise(F.format_string("%,.0f억", hundred_millions))
    return F.when(c.isNull(), "N/A").otherwise(shown)


def fmt_per_cent(c: Column) -> Column:
    """A percentage with its sign and one decimal; N/A for null."""
    return F.when(c.isNull(), "N/A").when(c == 0, "0.0%").otherwise(F.format_string("%+.1f%%", c))

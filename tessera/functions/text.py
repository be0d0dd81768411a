"""Text functions as column expressions; dictionaries and patterns are parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def strip_html(c: Column) -> Column:
    """Tags become spaces, common entities are decoded, white space is one space."""
    bare = F.regexp_replace(c, r"<(script|style)[^>]*>[^<]*</(script|style)>|<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def tokens(c: Column, least: int = 3, stop: Sequence[str] = ()) -> Column:
    """Distinct words: Hangul runs of two or more, and lower-cased Latin runs of ``least`` or more; stop words go."""
    words = F.array_distinct(F.concat(find_all(c, "[가-힣]{2,}"), F.transform(find_all(c, f"[A-Za-z]{{{least},}}"), F.lower)))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def strip_particle(c: Column, particles: Sequence[str], stem: int = 2) -> Column:
    """One trailing particle off, the longest first, if a stem of that length stays."""
    endings = "|".join(sorted(particles, key=lambda p: (-len(p), p)))
    return F.regexp_replace(c, f"^(.{{{stem},}}?)({endings})$", "$1")


def count_of(c: Column, word: Column | str) -> Column:
    """Non-overlapping occurrences of word."""
    w = F.lit(word) if isinstance(word, str) else word
    return F.when(F.length(w) > 0, ((F.length(c) - F.length(F.replace(c, w, F.lit("")))) / F.length(w)).cast("int")).otherwise(0)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once a row, however often use names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def hits(c: Column, patterns: Sequence[str]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(c, F.lit(p))
    return total


def best_family(c: Column, families: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """The pattern family with most hits; of equals the first."""
    names = F.array(*map(F.lit, families))
    best = lambda counts, top: F.when(top > 0, F.element_at(names, F.array_position(counts, top).cast("int"))).otherwise(otherwise)
    of = lambda text: once(F.array(*[hits(text, p) for p in families.values()]), lambda counts: best(counts, F.array_max(counts)))
    return once(c, of)


def first_class(c: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?\n]"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def evidence(c: Column, word: Column | str, most: int = 300) -> Column:
    """Sentences that contain word, joined and cut to ``most`` characters."""
    w = F.lower(F.lit(word) if isinstance(word, str) else word)
    return F.substring(F.array_join(F.filter(sentences(c), lambda s: F.contains(F.lower(s), w)), ". "), 1, most)


def window_around(c: Column, word: str, reach: int = 75) -> Column:
    """The text around the first hit, with ellipses where it is cut; null without a hit."""
    at = F.instr(F.lower(c), word.lower())
    start = F.greatest(at - reach, F.lit(1))
    end = F.least(at + len(word) - 1 + reach, F.length(c))
    cut = F.substr(c, start, end - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end < F.length(c), "...").otherwise("")))


def mentioned(c: Column, names: Sequence[str]) -> Column:
    """The names that stand in a text by themselves: no letter or figure before, and a blank, full stop, comma or the end behind; each once, in order.

    Every pattern begins with its name, so it is compiled once and tried only where the name stands.
    """
    stands = lambda name: F.contains(c, F.lit(name)) & c.rlike(rf"\Q{name}\E(?<![A-Za-z0-9]\Q{name}\E)(?=[ .,]|\z)")
    return F.filter(F.array(*[F.when(stands(name), F.lit(name)) for name in names]), lambda name: name.isNotNull())


def split_names(c: Column) -> Column:
    """Names of a list: split at commas, semicolons and slashes outside parentheses, cleaned, two characters or more."""
    parts = F.split(c, r"[,;](?![^(]*\))| / ")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\([^)]*\)", ""))), lambda p: F.length(p) >= 2)


def emails(c: Column) -> Column:
    """Plain addresses, and ones written with (at) and (dot), in lower case."""
    plain = find_all(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]")
    veiled = find_all(c, r"[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+ ?[\[(]dot[\])] ?[A-Za-z]+")
    opened = F.transform(veiled, lambda v: F.regexp_replace(F.regexp_replace(v, r" ?[\[(]at[\])] ?", "@"), r" ?[\[(]dot[\])] ?", "."))
    return F.array_sort(F.array_distinct(F.transform(F.concat(plain, opened), F.lower)))


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


# Legal forms and kinds of bodies in names.
LEGAL_PREFIXES = ["주식회사 ", "유한회사 ", "합자회사 ", "합명회사 ", "주식회사", "㈜ ", "(주) "]
LEGAL_SUFFIXES = [" 주식회사", " (주)", " ㈜", "(주)", "㈜", " 주식회사.", "주식회사", " 유한회사", " 유한책임회사"]
LEGAL_WITHIN = ["㈜", "(주)"]
BODY_SUFFIXES = [" 주식회사", " 공사", " 공단", " 재단", " 연구원", " 연구소", " 학교", " 대학교", " 대학", " 병원"]


def normalise_corp(c: Column) -> Column:
    """A company's name without legal forms and spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\(주\\)|주식회사|㈜|（주）|[ \t]", ""))


def normalise_partner(c: Column) -> Column:
    """A partner's name without legal forms before, after and within it, one kind of body, and a Latin reading in parentheses."""
    plain = lambda p: "\\Q" + p + "\\E"
    out = F.trim(c)
    for pattern in [*("^" + plain(p) for p in LEGAL_PREFIXES), *(plain(p) + "$" for p in LEGAL_SUFFIXES), *map(plain, LEGAL_WITHIN), "(?:" + "|".join(map(plain, BODY_SUFFIXES)) + ")$"]:
        out = F.trim(F.regexp_replace(out, pattern, ""))
    return F.trim(F.regexp_replace(out, r"\s*\([A-Za-z0-9 .,&-]+\)\s*$", ""))


def clean_partner(c: Column) -> Column:
    """A name as a filing writes it, without legal forms, short parentheses, circled numbers and marks at its ends; white space is one space."""
    bare = F.regexp_replace(c, r"주식회사|㈜|\([^)]{0,30}\)|[①-⑳]|\s+", " ")
    return F.btrim(F.regexp_replace(bare, " +", " "), F.lit(" ,.;:·•*-"))


def is_noise(c: Column, words: Sequence[str] = ("other", "total", "various")) -> Column:
    """Why a partner name is no name: the first rule that holds, or null."""
    return F.coalesce(
        F.when(c.isNull() | (F.length(F.trim(c)) < 2), "TOO_SHORT"),
        F.when(F.length(c) > 60, "TOO_LONG"),
        F.when(F.lower(c).isin(*words), "GENERIC"),
        F.when(c.rlike("^[0-9]"), "DIGIT_START"),
        F.when(c.rlike(r"\([^)]{15,}\)"), "LONG_PAREN"),
    )


def parse_loose(c: Column, fields: Sequence[str]) -> Column:
    """JSON out of an answer that should be JSON: (step, then each field as a string).

    Readings in this order, the first that works: the whole text, what a fence holds, what stands from the first brace to the last, and each
    field by its quoted key. step names it: whole, fenced, braces, keys, none. Values that the answer lacks are null.
    """
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    readings = [("whole", F.trim(c)), ("fenced", fenced), ("braces", braces)]
    is_object = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    tried = [F.struct(F.lit(step).alias("step"), is_object(F.try_parse_json(F.nullif(r, F.lit("")))).alias("v")) for step, r in readings]
    by_key = lambda f: F.nullif(F.regexp_extract(c, rf"(?s)[\"']{f}[\"']\s*:\s*[\"'](.*?)[\"']\s*(?=[,}}]|$)", 1), F.lit(""))
    values = lambda read: [F.try_variant_get(read["v"], f"$.{f}", "string").alias(f) for f in fields]
    keyed = F.transform(F.array(F.struct(*[by_key(f).alias(f) for f in fields])), lambda k: F.struct(F.when(F.coalesce(*[k[f] for f in fields]).isNotNull(), "keys").otherwise("none").alias("step"), *[k[f].alias(f) for f in fields]))
    read = F.transform(F.filter(F.array(*tried), lambda r: r["v"].isNotNull()), lambda r: F.struct(r["step"].alias("step"), *values(r)))
    return F.coalesce(F.get(read, F.lit(0)), F.get(keyed, F.lit(0)))


def hinted_links(html: Column, anchor: str, hints: Sequence[str]) -> Column:
    """(href, shown) of the anchors whose address or text has one of the hints, in any case. anchor: a pattern with both as groups."""
    found = F.transform(F.arrays_zip(find_all(html, anchor, 1).alias("href"), find_all(html, anchor, 2).alias("shown")), lambda a: F.struct(a["href"].alias("href"), strip_tags(a["shown"]).alias("shown")))
    has = lambda c: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(c), h))
    return F.filter(found, lambda a: has(a["href"]) | has(a["shown"]))

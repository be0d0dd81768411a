"""Questions to a company about a change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of each kind of change, in the order in which kinds are tried: marks in any case, and words of the content.
KINDS = [
    ("NEW", ["new"], ["신규", "신사업", "진출"]), ("REMOVED", ["removed"], ["철수", "청산", "매각"]), ("EXPANDED", ["expanded"], ["확대", "확장", "증설"]),
    ("SHRUNK", ["shrunk"], ["축소"]), ("CHANGED", ["changed"], ["변경", "교체"]),
]
PER_CENT, AMOUNT = r"[0-9]+(?:\.[0-9]+)?\s*[%％]", r"[0-9]+(?:\.[0-9]+)?\s*억(?:원)?"
#: Questions that a set gives, and all of them together, at most.
MOST_OF_SET, MOST = 5, 6


def every(headline: Column, content: Column) -> Column:
    """All that marks of a kind are looked for in."""
    return F.lower(F.concat_ws(" ", headline, content))


def kind_in(every: Column, content: Column) -> Column:
    """The first kind of change that either names; null if none."""
    said = lambda c, words: reduce(or_, [F.contains(c, F.lit(w)) for w in words])
    return F.coalesce(*[F.when(said(every, marks) | said(F.coalesce(content, F.lit("")), words), kind) for kind, marks, words in KINDS])


def kind_of(headline: Column, content: Column) -> Column:
    """The first kind of change that headline or content name; null if none."""
    return kind_in(every(headline, content), content)


def questions(headline: Column, content: Column, lead_type: Column, sets: Mapping[str, Sequence[str]]) -> Column:
    return questions_on(headline, kind_of(headline, content), lead_type, sets)


def questions_on(headline: Column, kind: Column, lead_type: Column, sets: Mapping[str, Sequence[str]]) -> Column:
    """The questions of the kind's set, else the lead type's, else the default one; before them one on the headline's percentage or amount, if it has one."""
    listed = F.create_map(*[x for name, asked in sets.items() for x in (F.lit(name), F.array(*map(F.lit, asked)))])
    own = F.slice(F.coalesce(listed[kind], listed[lead_type], listed[F.lit("default")]), 1, MOST_OF_SET)
    share, amount = F.regexp_extract(headline, PER_CENT, 0), F.regexp_extract(headline, AMOUNT, 0)
    about = F.split_part(headline, F.lit(","), F.lit(1))
    special = F.when(share != "", F.concat(about, F.lit(": as of when, and by which measure, is "), share, F.lit("?"))).when(amount != "", F.concat(about, F.lit(": what does "), amount, F.lit(" rest on?")))
    return F.slice(F.array_compact(F.concat(F.array(special), own)), 1, MOST)

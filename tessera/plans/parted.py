"""Texts in two parts, by sentences: those with a key word, which stand for a lead's evidence, and the others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text

KEY = "tion"
SENTENCES_SQL = "list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda s: trim(s, ' ')), lambda s: length(s) > 0)"
_JOINED_SQL = "coalesce(array_to_string(list_filter({}, lambda s: {}contains(lower(s), '{}')), '. '), '')"
#: Both parts as written.
EVIDENCE_SQL, REST_SQL = (_JOINED_SQL.format(SENTENCES_SQL, no, KEY) for no in ("", "NOT "))


def parted() -> tuple[Column, Column]:
    """The sentences of the column text that contain the key word, and the others, each joined; empty if there are none."""
    return parts_of(text.sentences(F.col("text")))


def parts_of(parts: Column) -> tuple[Column, Column]:
    """The same of a text's sentences."""
    has = lambda s: F.contains(F.lower(s), F.lit(KEY))
    joined = lambda keep: F.coalesce(F.array_join(F.filter(parts, keep), ". "), F.lit(""))
    return joined(has), joined(lambda s: ~has(s))

"""Phrases of texts that have no citation near them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<phrase:string,position:int>>"


def uncited(text: str, phrases: Sequence[re.Pattern], citations: Sequence[re.Pattern], reach: int) -> list[dict]:
    """Hits of the phrases, pattern by pattern, with no citation wholly within reach characters of the hit's first.

    Starts and ends of one pattern's citations ascend together. So the first that starts within reach before a hit ends
    first of all that do, and it alone is looked at.
    """
    cited = [np.array([m.span() for m in p.finditer(text)], np.int64).reshape(-1, 2) for p in citations]
    out = []
    for p in phrases:
        hits = [(m.start(), m.group()) for m in p.finditer(text)]
        at = np.array([h[0] for h in hits], np.int64)
        near = np.zeros(len(hits), bool)
        for spans in cited:
            k = np.searchsorted(spans[:, 0], at - reach)
            ends = np.append(spans[:, 1], np.iinfo(np.int64).max)
            near |= ends[k] <= at + reach
        out += [{"phrase": phrase, "position": place} for (place, phrase), known in zip(hits, near) if not known]
    return out


def uncited_phrases(phrases: Sequence[str], citations: Sequence[str], reach: int = 100) -> Callable[[Column], Column]:
    """A function of a text column: its uncited hits (phrase, position from 0), by pattern, then place. Null text has none."""
    patterns, marks = [re.compile(p) for p in phrases], [re.compile(p) for p in citations]

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: uncited(t or "", patterns, marks, reach))

    return find

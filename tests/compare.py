"""Rows of two engines in one form, whatever their order and column order."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterable, Sequence


def normal(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if x != x:
            return None
        return int(x) if x.is_integer() else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(normal, x))
    if isinstance(x, dict):
        return tuple(sorted((k, normal(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    return x if x is None or isinstance(x, (bool, int)) else str(x)


def normal_rows(names: Sequence[str], rows: Iterable[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(normal(r[i]) for i in order)) for r in rows)

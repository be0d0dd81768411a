"""Hard negatives against sorting all scores, with ties, repeated ids and rows that take no part."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, slot int"


def brute_force(rows: list[tuple], every: int, positives=5, most=3) -> list[tuple]:
    sound = [(i, [math.floor(256 * x) for x in v], y) for i, v, y, *_ in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda r: (-r[1], math.inf if r[0] is None else r[0])
    out = []
    for k, (i, v, y) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w)), z, n) for n, (j, w, z) in enumerate(sound)]
        for j, p, *_ in sorted([s for s in scored if s[2] == y and s[3] != k], key=rank)[:positives]:
            fit = sorted([s for s in scored if s[2] != y and 50 * p <= 100 * s[1] <= 95 * p], key=rank)[:most]
            out += [(i, j, r, m, p, s) for r, (m, s, *_) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(df, every: int) -> list[tuple]:
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0).collect()), key=str)


def vectors(seed: int, n: int, grid: int) -> list[tuple]:
    """Components on a coarse grid, so that many scores are equal; some rows are odd."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-grid, grid) / 16 + 0.25 for _ in range(4)], rng.randint(0, 2), 1.0, 0) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [(n, None, 1, 1.0, 0), (n + 1, [1.0, None, 1.0, 1.0], 1, 1.0, 0), (n + 2, [nan] * 4, 1, 1.0, 0), (n + 3, [inf] * 4, 1, 1.0, 0), (n + 4, [1.0] * 4, None, 1.0, 0)]


@pytest.mark.parametrize("seed,grid,bits", [(1, 6, 10), (2, 1, 2), (3, 40, 4)])
def test_by_brute_force(spark, monkeypatch, seed, grid, bits):
    """Small digits, blocks and groups take every path: several digits, ties by digits of the id, many cells."""
    monkeypatch.setattr(negatives, "SCORE_BITS", bits)
    monkeypatch.setattr(negatives, "ID_BITS", bits)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 60)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 4)
    rows = vectors(seed, 200, grid)
    want = brute_force(rows, 20)
    assert len(want) > 30
    assert mined(spark.createDataFrame(rows, SCHEMA), 20) == want


def test_repeated_rows_null_ids_and_lengths(spark):
    same = [(k, [0.5, 0.5], 0, 1.0, 0) for k in (0, 3, 3, 3, 4, 5, 6, 7)]
    rows = [*same, *[(k, [0.25, 0.5], 1, 1.0, 0) for k in (10, 10, 11, 9, None)], (0, [0.5, 0.5], 0, 1.0, 0), (20, [], 2, 1.0, 0), (30, [0.5, 0.25, 9.0], 2, 1.0, 0), (31, [-0.5, -0.5], 0, 1.0, 0)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 10) == brute_force(rows, 10)


def test_large_components_take_wider_numbers(spark):
    for scale in (1.0, 3e3, 3e5):
        rows = [(i, [scale * (1 + i % 7), scale * (i % 3)], i % 3, 1.0, 0) for i in range(40)]
        assert mined(spark.createDataFrame(rows, SCHEMA), 10) == brute_force(rows, 10)
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, [8e6] * 9, 1, 1.0, 0), (1 << 62, [1.0], 1, 1.0, 0)], SCHEMA), 10)


def test_no_rows_or_no_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA), 10) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1, 1.0, 0), (2, [1.0], 2, 1.0, 0)], SCHEMA), 10) == []
    assert mined(spark.createDataFrame([(10, [1.0], 1, 1.0, 0)], SCHEMA), 10) == []

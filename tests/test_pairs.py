"""Shared-pair counting against counting all pairs, with hubs."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.operators import pairs
from tessera.operators.pairs import shared_pairs


def brute_force(rows: list[tuple], least: int) -> set[tuple]:
    members: dict = {}
    for m, *item in rows:
        if m is not None and None not in item:
            members.setdefault(tuple(item), set()).add(m)
    counts = Counter(p for ms in members.values() for p in combinations(sorted(ms), 2))
    return {(*p, n) for p, n in counts.items() if n >= least}


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_by_brute_force(spark, monkeypatch, least):
    """Items of every size, a few hubs of which some members have several, repeated and null rows."""
    rng = random.Random(least)
    rows = [(rng.randrange(120), f"p{rng.randrange(60)}", rng.choice("xy")) for _ in range(900)]
    rows += [(m, f"hub{k}", "x") for k in range(7) for m in range(120) if rng.random() < 0.2 + 0.1 * k]
    rows += rows[:50] + [(None, "p1", "x"), (1, None, "x"), (2, "p1", None)]
    df = spark.createDataFrame(rows, "corp long, partner string, relation string")
    for light in (1, 5, 20, 1000):
        got = [tuple(r) for r in shared_pairs(df, "corp", ["partner", "relation"], least, light, most_buckets=0).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_force(rows, least), light
    for bucket, at_once in ((1000, 10), (50, 1000), (7, 10**6)):
        monkeypatch.setattr(pairs, "AT_ONCE", at_once)
        got = [tuple(r) for r in shared_pairs(df, "corp", ["partner", "relation"], least, bucket=bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_force(rows, least), bucket


def test_members_by_name(spark):
    rows = [("é", "x"), ("a", "x"), ("é", "y"), ("a", "y"), ("b", "y"), ("가", "x"), ("가", "y")]
    df = spark.createDataFrame(rows, "corp string, partner string")
    got = {tuple(r) for r in shared_pairs(df, "corp", ["partner"], 2, bucket=2).collect()}
    assert got == {("a", "é", 2), ("a", "가", 2), ("é", "가", 2)} == {tuple(r) for r in shared_pairs(df, "corp", ["partner"], 2, most_buckets=0).collect()}


def test_no_rows(spark):
    df = spark.createDataFrame([], "corp long, partner string")
    assert shared_pairs(df, "corp", ["partner"]).collect() == []


def test_hub_makes_no_square_of_pairs(spark):
    """A hub of 5,000: pairs come from the light items; none from the hub, which is looked up."""
    members = spark.range(5000).withColumnRenamed("id", "corp")
    hub = members.select("corp", F.lit("hub").alias("partner"))
    light = members.select("corp", F.explode(F.array(*[F.concat(F.lit(f"p{k}-"), F.floor(F.col("corp") / (5 + k)).cast("string")) for k in range(3)])).alias("partner"))
    got = shared_pairs(hub.unionByName(light), "corp", ["partner"], 3, most_buckets=0)
    want = sum(1 for a in range(5000) for b in range(a + 1, min(a + 8, 5000)) if 1 + sum(a // (5 + k) == b // (5 + k) for k in range(3)) >= 3)
    assert got.count() == want == shared_pairs(hub.unionByName(light), "corp", ["partner"], 3).count()


def test_dealt_hubs_leave_no_large_task(spark):
    """Members with many hubs: the hubs before their last two are dealt over cells, none of which has much more than the others."""
    rows = spark.range(5000).select(F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("no"), F.col("id").alias("m"), F.lit(5000).cast("long").alias("degree"))
    bits = F.length(F.bin(F.floor((F.col("degree") - 1) / 500)))
    assert rows.select(F.call_function("shiftleft", F.lit(1), bits).alias("k")).distinct().collect()[0].k == 16
    made = pairs._dealt_wedges(rows.filter("no < 1"), 500)
    cells = made.select(F.pmod(F.xxhash64("a"), F.lit(16)).alias("x"), F.pmod(F.xxhash64("b"), F.lit(16)).alias("y"))
    sizes = sorted(r["count"] for r in cells.select(F.least("x", "y"), F.greatest("x", "y")).groupBy("least(x, y)", "greatest(x, y)").count().collect())
    assert sum(sizes) == 5000 * 4999 // 2 and len(sizes) == 16 * 17 // 2
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_no_pair_moves_without_hubs(spark):
    """However many buckets members fill, pairs of items that are no hubs are counted where they are made, not shuffled."""
    rows = [(m, k, "x") for k in range(40) for m in range(k, 200, 7)]
    df = spark.createDataFrame(rows, "corp long, partner long, relation string")
    found = shared_pairs(df, "corp", ["partner", "relation"], 3, most_buckets=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "keys=[a" not in plan
    assert {tuple(r) for r in found.collect()} == brute_force(rows, 3)


@pytest.mark.parametrize("most_buckets", [0, 64])
def test_first_pairs(spark, most_buckets):
    """Each cell keeps its own first pairs; ties go by a, then b."""
    rng = random.Random(7)
    rows = [(rng.randrange(90), rng.randrange(30), "x") for _ in range(1200)]
    df = spark.createDataFrame(rows, "corp long, partner long, relation string")
    want = sorted(brute_force(rows, 2), key=lambda p: (-p[2], p[0], p[1]))[:25]
    got = shared_pairs(df, "corp", ["partner", "relation"], 2, light=45, bucket=20, most_buckets=most_buckets, first=25)
    assert [tuple(r) for r in got.collect()] == want


def test_nothing_is_copied_to_cells(spark):
    """Members of every item in every bucket: cells read packed buckets, no rows or lists are dealt to each cell over a shuffle."""
    rows = [(k, m) for k in range(40) for m in range(k % 3, 300, 3)]
    df = spark.createDataFrame(rows, "no long, m long")
    found = pairs._counted_in_cells(df, 3, 12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force([(m, k) for k, m in rows], 3)
    assert sorted(map(tuple, pairs._counted_in_cells(df, 3, 12, first=9).orderBy(F.desc("shared"), "a", "b").limit(9).collect())) == sorted(sorted(got, key=lambda p: (-p[2], p[0], p[1]))[:9])


@pytest.mark.parametrize("moved", [0, 10**9])
def test_either_way_of_hubs(spark, monkeypatch, moved):
    """Hubs that all copies of members share: pairs move only where they are few, whatever there are of buckets."""
    rng = random.Random(moved)
    rows = [(m, rng.randrange(30), "x") for m in range(100) for _ in range(9)] + [(m, f"hub{k}", "x") for k in range(5) for m in range(0, 100, k + 1)]
    df = spark.createDataFrame([(m, str(p), r) for m, p, r in rows], "corp long, partner string, relation string")
    monkeypatch.setattr(pairs, "MOVED_A_ROW", moved)
    dealt = []
    monkeypatch.setattr(pairs, "_dealt_wedges", lambda *a, made=pairs._dealt_wedges: dealt.append(1) or made(*a))
    got = [tuple(r) for r in shared_pairs(df, "corp", ["partner", "relation"], 3, light=40, most_buckets=0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force([(m, str(p), r) for m, p, r in rows], 3) and bool(dealt) == bool(moved)


def test_members_with_too_few_items_go(spark, monkeypatch):
    """Copies of the same members: the first pairs are known from those with most items, and others aren't paired; ties go by a, then b."""
    rng = random.Random(5)
    own = {m: rng.sample(range(50), 3 + m) for m in range(12)}
    rows = [(m + 100 * copy, f"p{k}") for copy in range(9) for m, items in own.items() for k in items]
    df = spark.createDataFrame(rows, "corp long, partner string")
    want = sorted(brute_force(rows, 3), key=lambda p: (-p[2], p[0], p[1]))[:30]
    monkeypatch.setattr(pairs, "PROBE_FROM", 0)
    monkeypatch.setattr(pairs, "PROBED", 20)
    counted = []
    monkeypatch.setattr(pairs, "_counted_in_cells", lambda rows, *a, made=pairs._counted_in_cells: counted.append(rows.select("m").distinct().count()) or made(rows, *a))
    assert [tuple(r) for r in shared_pairs(df, "corp", ["partner"], 3, first=30).collect()] == want
    assert counted[0] == 20 and counted[1] < 20
    monkeypatch.setattr(pairs, "PROBED_ROWS", 1)  # no member is small enough to begin with: all are paired
    assert [tuple(r) for r in shared_pairs(df, "corp", ["partner"], 3, first=30).collect()] == want

"""Name matching against trying every name on every text."""

from __future__ import annotations

import random

from tessera.operators.dictionary import containing, longest_prefix
from tessera.sources import landing


def pairs(df) -> set[tuple]:
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_containing_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda a, b: "".join(rng.choice("abé ") for _ in range(rng.randint(a, b)))
    texts = [word(0, 40) for _ in range(300)] + ["", None, "ab", "a", "aaa"]
    names = [word(1, 7) for _ in range(200)] + ["a", "é", " ", "ab", "", None, "zzz", "a", "abc"]
    want = {(x, y) for x in texts if x is not None for y in names if y and y in x}
    got = containing(spark.createDataFrame([(x,) for x in texts], "t string"), "t", spark.createDataFrame([(x,) for x in names], "n string"), "n")
    assert pairs(got) == want and len(want) > 1000


def test_containing_without_names_or_texts(spark):
    none, one = spark.createDataFrame([], "x string"), spark.createDataFrame([("a",)], "x string")
    assert pairs(containing(none, "x", one, "x")) == pairs(containing(one, "x", none, "x")) == set()


def test_many_names_make_no_nested_loop(spark, capsys):
    names = spark.range(100_000).selectExpr("concat('name', id) AS name")
    items = spark.range(2_000).selectExpr("concat('u', id) AS url", "concat('about name', id * 100, ' today') AS title", "concat('h', id % 2) AS host", "CAST(NULL AS DATE) AS published_at")
    media = spark.createDataFrame([("h0", "T1"), ("h2", "T2")], "host string, tier string")
    found = landing.news_items(items, media, names, "2024-01-31")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    found.explain()
    assert "NestedLoop" not in capsys.readouterr().out and "Join Cross" not in plan
    got = {r["url"]: r["name"] for r in found.collect()}
    assert len(got) == 1_000 and got["u8"] == "name8" and got["u0"] == "name0" and got["u998"] == "name9"  # the first name of several


def test_longest_prefix(spark):
    names = ["ABC", "ABC Steel", "ABC Steel Works", "AB", "Zeta", "", None, "Z"]
    groups = ["ABC", "ABC Steel", "Z", "Zeta Group", "", None]
    got = longest_prefix(spark.createDataFrame([(x,) for x in names], "n string"), "n", spark.createDataFrame([(x,) for x in groups], "g string"), "g")
    assert pairs(got) == {("ABC", "ABC"), ("ABC Steel", "ABC Steel"), ("ABC Steel Works", "ABC Steel"), ("Zeta", "Z"), ("Z", "Z")}

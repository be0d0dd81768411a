"""Numbers, verification scores and the as-of join against hand-made rows and plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import verification as V
from tessera.operators.relational import as_of


def lexed(spark, said):
    return [tuple(x) for x in spark.createDataFrame([(said,)], "x string").select(numbers.lex(F.col("x")).alias("y")).first()["y"]]


def test_every_unit_and_sign(spark):
    said = "1.5조, 2,509억 원, 3 천만, 4백만과 12만; 5,000 plain, +6.5% -13% 7 %, 1.2.3만 and 1.2.3%"
    assert lexed(spark, said) == [
        ("1.5조", 1.5e12, False), ("2,509억", 2509e8, False), ("3 천만", 3e7, False), ("4백만", 4e6, False), ("12만", 12e4, False),
        ("2.3만", 2.3e4, False), ("+6.5%", 6.5, True), ("-13%", -13.0, True), ("7 %", 7.0, True),
    ]
    assert lexed(spark, "") == [] and lexed(spark, "조 % 억") == []
    assert spark.createDataFrame([(None,)], "x string").select(numbers.lex(F.col("x")).alias("y")).first()["y"] is None


@pytest.mark.parametrize(
    "value,per_cent,truth,same",
    [
        (10.0, True, 12.0, True), (10.0, True, 12.001, False), (-3.0, True, -5.0, True),
        (2e6, False, 1.9e6, True), (2e6, False, 1.89e6, False), (1.9e6, False, 2e6, True), (1e6, False, 1.01e6, False), (1e6, False, 1e6, True),
        (500.0, False, 500.0, True), (500.0, False, 501.0, False), (2e6, False, 1e6, False),
    ],
)
def test_both_tolerances(spark, value, per_cent, truth, same):
    rows = spark.createDataFrame([(1, "a", value, per_cent, truth)], "id int, k string, value double, per_cent boolean, truth double")
    assert rows.select(numbers.agrees(F.col("value"), F.col("per_cent"), F.col("truth")).alias("y")).first()["y"] is same
    met = V.tolerance_matches(rows.select("id", "k", "value", "per_cent"), rows.select("k", "truth"), ["k"], "id")
    assert [r["id"] for r in met.collect()] == ([1] if same else [])


def test_band_join_by_brute_force(spark):
    rng = random.Random(2)
    draw = lambda: rng.choice([rng.uniform(-9, 9), rng.uniform(-9, 9), 10 ** rng.uniform(5.9, 8), float(rng.randint(0, 40)), 1e6, 0.0])
    found = [(i, rng.choice("abc"), draw(), rng.random() < 0.4) for i in range(500)] + [(900, "a", None, True), (901, None, 1.0, True)]
    truths = [(rng.choice("abd"), draw()) for _ in range(120)] + [("a", None), (None, 1.0)] + [("a", 1.0)] * 3

    def agrees(v, p, t):
        if p:
            return abs(t - v) <= 2.0
        return abs(t - v) / max(t, v) <= 0.05 if v > 1e6 and t > 1e6 else t == v

    want = {i for i, k, v, p in found if v is not None and any(k == x and k is not None and t is not None and agrees(v, p, t) for x, t in truths)}
    df = spark.createDataFrame(found, "id int, k string, value double, per_cent boolean")
    met = V.tolerance_matches(df, spark.createDataFrame(truths, "k string, truth double"), ["k"], "id")
    rows = [r["id"] for r in met.collect()]
    assert sorted(rows) == sorted(want) and 50 < len(want) < 450
    assert "Cartesian" not in met._jdf.queryExecution().toString() and "NestedLoop" not in met._jdf.queryExecution().toString()


def company(year, revenue=2_000_000, op=100_000, net=50_000, liabilities=400, equity=1000, code=1):
    return (code, year, revenue, op, net, 3_000_000, liabilities, equity, 500, 250, 0, 77)


COLUMNS = "corp_code long, fiscal_year int, revenue long, operating_income long, net_income long, total_assets long, total_liabilities long, total_equity long, current_assets long, current_liabilities long, cash long, inventory long"


def test_truth_is_of_five_years_and_leaves_out_zeros(spark):
    held = V.truth(spark.createDataFrame([company(y, revenue=y * 1000) for y in range(2010, 2018)], COLUMNS)).first()
    assert len(held["amounts"]) == 5 * 7 and len(held["ratios"]) == 5 * 6  # cash is 0
    assert {v for v in held["amounts"] if v in {y * 1000.0 for y in range(2010, 2018)}} == {y * 1000.0 for y in range(2013, 2018)}
    assert [r["revenue"] for r in held["last"]] == [2017000, 2016000] and held["ratios"][:2] == [40.0, 200.0]


def scored(spark, body, evidence="the evidence of some lead with words", source="", years=()):
    held = V.truth(spark.createDataFrame(list(years), COLUMNS))
    row = spark.createDataFrame([(1, body, evidence, source)], "corp_code long, body string, evidence string, source string").join(held, "corp_code", "left")
    c = F.col
    out = row.select(
        V.numeric_score(numbers.lex(c("body")), c("amounts"), c("ratios")), V.direction_score(c("body"), c("last")), V.evidence_score(c("body"), c("evidence")),
        V.grounding_score(c("body"), c("source")), V.cross_check(c("body"), c("amounts"), c("ratios"), c("source")),
    ).first()
    return tuple(out)


def test_scores_of_hand_made_articles(spark):
    up = [company(2020), company(2021, op=150_000)]
    # no figures known; no numbers; two of three numbers agree: 200만 with sales, 40% with the debt ratio
    assert scored(spark, "200만")[0] == 50
    assert scored(spark, "none here", years=up)[0] == 70
    assert scored(spark, "매출 205만, 부채비율 41.5%, 그리고 999억", years=up)[0] == 66
    # direction: agrees, doesn't, is mixed, flat, one year only
    assert [scored(spark, b, years=up)[1] for b in ("증가 개선", "감소", "증가 감소", "")] == [100, 30, 75, 75]
    assert scored(spark, "증가", years=[company(2020), company(2021)])[1] == 30 and scored(spark, "증가", years=up[:1])[1] == 70
    # evidence: short; three of its six words (the evidence some lead with words) are half, so all
    assert scored(spark, "x", evidence="short")[2] == 70
    assert scored(spark, "the evidence with", evidence="the evidence some lead with words")[2] == 100
    assert scored(spark, "the", evidence="the evidence some lead with words")[2] == 33
    assert scored(spark, "x", evidence="12345 67890 12345 67890 12345 67890")[2] == 70
    # grounding: no long word; one of two in the source
    assert scored(spark, "abc 회사 는")[3] == 80 and scored(spark, "Alpha Beta", source="alpha")[3] == 60
    # cross check: no number 100, one of two nouns contained
    assert scored(spark, "Alpha Beta", source="of alphabets")[4] == int(60 + 0.4 * 50)
    assert scored(spark, "205만 41% 7만", source="", years=up)[4] == int(66 * 0.6 + 40)


def test_total_and_movement(spark):
    row = spark.createDataFrame([(100, 30, 70, 80)], "a int, b int, c int, d int")
    assert row.select(V.total(*map(F.col, "abcd"))).first()[0] == int(30 + 7.5 + 17.5 + 16)
    cases = [(103, 100, "up"), (102, 100, "flat"), (97, 100, "down"), (-50, -100, "up"), (5, 0, "up"), (-5, 0, "down"), (0, 0, "flat"), (None, 1, None), (1, None, None)]
    rows = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(cases)], "i int, n long, t long").select("i", V.moved(F.col("n"), F.col("t")).alias("m"))
    assert [r["m"] for r in sorted(rows.collect())] == [m for *_, m in cases]


@pytest.mark.parametrize("part", ["month", "day", "year"])
def test_as_of_by_brute_force(spark, part):
    rng = random.Random(4)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(200))
    left = [(i, rng.choice("aabc"), day()) for i in range(150)] + [(900, None, day()), (901, "a", None), (902, "z", day()), (5, "a", day()), (5, "a", day())]
    right = [(rng.choice("aaad"), day(), rng.randrange(1000)) for _ in range(80)] + [(None, day(), 1), ("a", None, 2), ("b", dt.date(2019, 1, 1), None)]
    want = []
    for i, k, at in left:
        fits = [(d, v is not None, v or 0, v) for x, d, v in right if x is not None and d is not None and at is not None and x == k and d <= at]
        want.append((i, k, at, max(fits)[3] if fits else None))
    a = spark.createDataFrame(left, "id int, k string, at date")
    b = spark.createDataFrame(right, "k string, then date, v int")
    got = [tuple(r) for r in as_of(a, b, ["k"], "at", "then", ["v"], part).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_as_of_without_rows(spark):
    a, b = spark.createDataFrame([], "id int, k string, at date"), spark.createDataFrame([], "k string, then date, v int")
    assert as_of(a, b, ["k"], "at", "then", ["v"]).collect() == []
    one = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1))], "id int, k string, at date")
    assert [tuple(r) for r in as_of(one, b, ["k"], "at", "then", ["v"]).collect()] == [(1, "a", dt.date(2020, 1, 1), None)]


def test_scores_read_texts_once(spark):
    """Numbers, nouns and words are found once a row, however often a score names them: the patterns stand once in the plan."""
    df = spark.createDataFrame([("매출 120만, 이익률 5%", "매출 증가", [1.2e6], [5.0])], "body string, source string, amounts array<double>, ratios array<double>")
    c = F.col
    plan = lambda score: df.select(score.alias("y"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert plan(V.cross_check(c("body"), c("amounts"), c("ratios"), c("source"))) == 4
    assert plan(V.evidence_score(c("body"), c("source"))) == 4 == plan(V.grounding_score(c("body"), c("source")))

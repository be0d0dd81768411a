"""Operators on small tables with nulls, blanks, ties, repeats and nothing at all."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import graph, leads, relational, search
from tessera.sources import landing, sinks
from tessera.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_pick_first_has_a_total_order(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("a", 1, "x"), (None, 5, "n"), (None, 4, "m")], "k string, o int, v string")
    assert rows(relational.pick_first(df, ["k"], F.col("o"), F.col("v"))) == [("a", 1, None), (None, 4, "m")]
    assert relational.pick_first(df.limit(0), ["k"], F.col("o")).count() == 0


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "", None)], "id int, v string, n int")
    new = spark.createDataFrame([(2, "b", 7), (1, "", 9), (3, None, 1)], "id int, v string, n int")
    assert rows(relational.upsert_overwrite(base, new, ["id"])) == [(1, "", 9), (2, "b", 7), (3, None, 1)]
    merge = lambda rule: rows(relational.upsert_merge(base, new, ["id"], {"v": rule, "n": "greatest"}))
    assert merge("fill_new") == [(1, "a", 9), (2, "b", 7), (3, None, 1)]
    assert merge("fill_old") == [(1, "a", 9), (2, "b", 7), (3, None, 1)]
    assert merge("old") == [(1, "a", 9), (2, "", 7), (3, None, 1)]
    assert merge("new") == [(1, "", 9), (2, "b", 7), (3, None, 1)]
    assert rows(relational.insert_ignore(base, new.union(new), ["id"], F.col("n"))) == [(1, "a", 5), (2, "", None), (3, None, 1)]


def test_sync_says_what_to_do(spark):
    rules = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "code string, v string")
    stored = spark.createDataFrame([("b", None), ("c", "4"), ("d", "5")], "code string, v string")
    assert rows(relational.sync(rules, stored, "code", ["v"])) == [("a", "add"), ("b", "keep"), ("c", "update"), ("d", "deactivate")]


EDGES = [(1, 10, "P", "customer", 1), (1, 11, "Q", "customer", 1), (1, 12, "R", "customer", 2), (1, 12, "R", "customer", 2), (1, 10, "P", "supplier", 2), (2, 1, "S", "supplier", 1)]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "corp_code long, partner_id long, partner_name string, relation string, period int")


def test_concentration_by_hand(edges):
    got = {(r["corp_code"], r["relation"]): (r["hhi"], r["level"], r["top_partner"]) for r in graph.concentration(edges).collect()}
    assert got[1, "customer"] == (3750.0, "HIGH", "R")
    assert got[2, "supplier"] == (10000.0, "HIGH", "S")


def test_equal_weight_hhi(spark):
    got = [one(spark, graph.equal_weight_hhi(F.col("x")), n, "long") for n in (0, 1, 2, 3, 4)]
    assert got == [10000, 10000, 5000, 3333, 2500]


def test_period_changes_by_hand(edges):
    got = {(r["corp_code"], r["partner_name"]): r["change"] for r in graph.period_diff(edges, *graph.last_two(edges)).collect()}
    assert got == {(1, "P"): "changed", (1, "Q"): "lost", (1, "R"): "new"}
    alert = graph.change_alerts(edges).first()
    assert (alert["significance"], alert["supplier_involved"]) == (2 + 3 + 2, False)


def test_significance_rule(spark):
    assert one(spark, graph.significance(F.lit(3), F.lit(2), F.lit(1), F.lit(True)), None) == 29
    assert one(spark, graph.significance(F.lit(90), F.lit(2), F.lit(1), F.lit(True)), None) == 100


def test_hops_stop_at_the_bound(spark):
    chain = spark.createDataFrame([(i, i + 1, "x", "supplier", 1) for i in range(6)], "corp_code long, partner_id long, partner_name string, relation string, period int")
    start = spark.createDataFrame([(0,)], "node long")
    got = {r["node"]: (r["hops"], r["path"]) for r in graph.hops_from(chain, start, 3).collect()}
    assert got == {0: (0, [0]), 1: (1, [0, 1]), 2: (2, [0, 1, 2]), 3: (3, [0, 1, 2, 3])}


def test_graph_of_nothing(edges, spark):
    none = edges.limit(0)
    companies = spark.createDataFrame([], "corp_code long, sector string, corp_name string")
    for df in (graph.concentration(none), graph.risk_rank(none), graph.change_alerts(none), graph.sector_flows(none, companies), graph.two_waves(none, 1)):
        assert df.count() == 0


@pytest.mark.parametrize(("shown", "value"), [("(1,234)", -1234.0), ("1,234.5", 1234.5), ("-", None), ("", None), (" 7 ", 7.0), (None, None), ("x", None)])
def test_parse_amount(spark, shown, value):
    assert one(spark, numbers.parse_amount(F.col("x")), shown) == value


def test_recency_of_coming_and_unknown_dates(spark):
    today = F.lit("2024-01-31").cast("date")
    got = [one(spark, numbers.recency(F.col("x").cast("date"), today), d) for d in ("2024-02-05", "2024-01-01", "2023-12-01", "2023-11-10", "2023-08-10", "2020-01-01", None)]
    assert got == [1.0, 1.0, 0.7, 0.7, 0.5, 0.3, 0.3]


def test_text_functions(spark):
    assert one(spark, text.tokens(F.col("x"), stop=["the"]), "The cat, the CAT 고양이 a") == ["고양이", "cat"]
    assert one(spark, text.tokens(F.col("x")), "") == []
    assert one(spark, text.count_of(F.col("x"), "aa"), "aaaaa") == 2
    assert one(spark, text.count_of(F.col("x"), ""), "abc") == 0
    assert one(spark, text.evidence(F.col("x"), "Cat"), "A cat sat. No dog!\nCATS win?") == "A cat sat. CATS win"
    assert one(spark, text.window_around(F.col("x"), "hit", 3), "abcdefHITghijkl") == "...defHITghi..."
    assert one(spark, text.window_around(F.col("x"), "hit", 3), "none") is None
    assert one(spark, text.split_names(F.col("x")), "A Co (x, y), B Co; C / Dee Inc") == ["A Co", "B Co", "Dee Inc"]
    assert one(spark, text.emails(F.col("x")), "Mail A.b@X.org or me (at) home (dot) net.") == ["a.b@x.org", "me@home.net"]
    assert one(spark, text.strip_particle(F.col("x"), ["s", "ies"]), "parties") == "part"
    assert one(spark, text.best_family(F.col("x"), {"A": ["a"], "B": ["b"]}, "none"), "ab") == "A"
    assert one(spark, text.best_family(F.col("x"), {"A": ["a"], "B": ["b"]}, "none"), "") == "none"
    assert [one(spark, text.is_noise(F.col("x")), v) for v in (None, "a", "9 lives", "Total", "Good Co", "x" * 61)] == ["TOO_SHORT", "TOO_SHORT", "DIGIT_START", "GENERIC", None, "TOO_LONG"]


def test_leads_keep_the_first_rule_of_a_type(spark):
    rules = spark.createDataFrame([("R2", "t", 1, ["new"], [], [], 3), ("R1", "t", 5, ["plan"], ["old"], ["city"], 3)], "rule_code string, lead_type string, severity int, keywords array<string>, excluded array<string>, context array<string>, least int")
    docs = spark.createDataFrame([(1, "s", "A new plan. City hall."), (2, "s", "An old plan. City."), (3, "s", None), (4, "s", ""), (5, "s", "A plan. New.")], "doc_id long, source string, text string")
    got = rows(leads.detect(docs, rules), "doc_id", "rule_code", "evidence")
    assert got == [(1, "R1", "A new plan"), (5, "R2", "New")]


def test_search_scores(spark):
    docs = spark.createDataFrame([(1, "k", "cat cat dog"), (2, "k", "dog"), (3, "l", "cat " * 50), (4, "l", ""), (5, "l", None)], "doc_id long, key string, text string")
    got = {r["doc_id"]: r["score"] for r in search.bm25(docs, ["cat"]).collect()}
    assert got.keys() == {1, 3} and got[1] > 0
    assert search.bm25(docs.limit(0), ["cat"]).count() == 0


def test_landed_files(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"rcept_no": "1", "report_nm": "b", "rcept_dt": "2"}\n{"rcept_no": "1", "report_nm": "a", "rcept_dt": "1"}\nbroken\n')
    assert rows(landing.read_filings(spark, str(tmp_path / "f.json")), "rcept_no", "report_nm") == [("1", "a")]
    lists = spark.createDataFrame([("c", 2020, "OFS", "Revenue", "5"), ("c", 2020, "CFS", "Sales", "1,000"), ("c", 2020, "CFS", "Revenue", "-"), ("c", 2020, "CFS", "Net  Income", "7")], landing.ACCOUNT)
    assert rows(landing.accounts(lists), "corp_code", "revenue", "operating_income", "net_income") == [("c", 1000.0, None, 7.0)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1.html", "<p>한글</p>".encode("euc-kr"))
        z.writestr("0.xml", "<a>first &amp; x</a>")
    assert rows(landing.read_zip_texts(spark, str(tmp_path / "a.zip")), "text") == [("first & x 한글",)]
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w") as z:
        z.writestr("big", "x" * 100)
    with pytest.raises(Exception, match="100 bytes"):
        landing.zip_texts(spark.createDataFrame([("p", bomb.getvalue())], "path string, content binary"), most=10).collect()


def test_sinks_write_files(spark, tmp_path):
    contacts = spark.createDataFrame([(1, "n", "a@b.c", 0), (2, "m", "_phone:1", 0), (3, "o", None, 1)], "id long, person string, email string, user_verified int")
    sinks.write_contact_csv(contacts, str(tmp_path / "csv"))
    assert rows(spark.read.csv(str(tmp_path / "csv"), header=True), "id") == [("1",), ("3",)]
    reports = spark.createDataFrame([(2, "c", "t", "d", 5), (1, "c", "t", "d", 6)], "id long, corp_code string, report_type string, rcept_dt string, n_chars long")
    sinks.write_index_json(reports, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index")).first()["chars"] == 11
    sinks.write_table(reports, str(tmp_path / "table"))
    sinks.write_table(reports.limit(1), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_stream_state_goes_on_over_batches(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    source = str(tmp_path / "in")

    def land(*events):
        spark.createDataFrame([(i, u, s) for i, u, s in events], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)

    start, hour = 1704067200, 3600
    land((1, 7, start), (2, 7, start + hour), (3, 8, start), (6, 9, 0))  # 6: the watermark begins at the epoch
    land((4, 7, start + 2 * hour), (5, 8, start + 30 * hour))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = {r["event_id"]: r["repeat"] for r in jobs.run_backlog(jobs.mark_repeats(stream)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_missing_table_is_empty(spark):
    assert landing.table_or_empty(spark, "no_such_table_here", "id long").count() == 0


def test_patterns_run_once_a_row(spark):
    """A family's count is used several times, but each pattern stands once in the plan."""
    rows = spark.createDataFrame([("ab",), ("b",), (None,)], "x string").select(text.best_family(F.col("x"), {"A": ["a"], "B": ["b", "c"]}, "none").alias("y"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 3
    assert [r.y for r in rows.collect()] == ["A", "B", "none"]

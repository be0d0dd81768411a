"""Steps whose work or memory grew faster than needed: results on hand-made rows, and what must not be in their plans."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tessera.functions import contact, numbers, text
from tessera.operators import filings, relational, verification
from tessera.plans.catalog import ORACLE_SQL, QUERIES
from tessera.sources import landing
from tests.compare import normal_rows


def test_numbers_of_a_lead_meet_its_companys_values(spark):
    """Percentages within 2 points, large amounts within 5 %, others equal; without values none agrees."""
    rows = [(1, "47% and 105억, of 3만, 9%", [45.0, 1e10, 3e4]), (2, "48% and 106억, of 4만", [45.0, 1e10, 3e4]), (3, "5%", None)]
    df = spark.createDataFrame(rows, "id int, said string, truth array<double>").withColumn("large", F.filter("truth", lambda v: v > 1e6))
    got = df.select("id", verification.agreeing(numbers.lex(F.col("said")), F.col("truth"), F.col("large")).alias("n")).collect()
    assert {r.id: r.n for r in got} == {1: 3, 2: 0, 3: 0}


def test_numbers_are_parted_from_units_without_patterns(spark):
    """lex has one pattern for each kind of number; blanks of every kind and thousands' commas go."""
    df = spark.createDataFrame([("1,234.5 \t억 and 12천만 3백만, -4.5 \n% or ,%",)], "c string")
    x = numbers.lex(F.col("c"))
    assert [(r["value"], r["per_cent"]) for r in df.select(x.alias("x")).first().x] == [(1234.5e8, False), (12e7, False), (3e6, False), (-4.5, True)]
    assert "regexp_replace" not in df.select(x)._jdf.queryExecution().optimizedPlan().toString()


def test_accounts_are_picked_without_sorts(spark):
    lists = spark.createDataFrame([("c", 2020, "OFS", "Sales", "1"), ("c", 2020, "CFS", "Revenue", "2"), ("c", 2020, "CFS", "Unknown", "3"), ("d", 2020, "OFS", "Sales", "x")], "corp_code string, fiscal_year int, fs_div string, account_nm string, amount string")
    out = landing.accounts(lists)
    assert [(r.corp_code, r.revenue) for r in out.collect()] == [("c", 2.0)]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(10)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert relational.dealt(df, 10, "id").rdd.getNumPartitions() == tasks
    assert relational.dealt(df, 40 * relational.ROWS_A_TASK, "id").rdd.getNumPartitions() == 40
    assert relational.spread(df, 10, "id") is df and relational.spread(df, 40 * relational.ROWS_A_TASK, "id").rdd.getNumPartitions() == 40


def test_contexts_are_not_written_where_not_wanted(spark):
    df = spark.createDataFrame([(1, "주요 공급사: alpha, beta")], "id int, body string")
    assert filings.relations(df, "id", "body", context=False).columns == ["id", "relation", "name"]
    plan = QUERIES["txt_relation_extract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "context" not in plan and "RepartitionByExpression" in plan


def test_signatures_look_for_a_mobile_once(spark):
    df = spark.createDataFrame([("홍보팀 김철수 팀장 010-1234-5678, 02-555-1000 a@b.com",)], "c string")
    out = df.select(contact.signature(F.col("c")).alias("s"))
    assert tuple(out.first().s) == ("김철수", "팀장", "홍보팀", "010-1234-5678", "02-555-1000", "a@b.com")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(c#") == 5  # name, title, mobile, phone, address


def test_sentences_of_evidence_are_cut_once(spark):
    plan = QUERIES["l_evidence_unique"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1


def test_mentions_need_no_pattern_a_row(spark):
    """Names by themselves; a line's end is not the text's end, and marks in a name are plain."""
    df = spark.createDataFrame([(1, "sch, xsch sch2 and a.b"), (2, "xsch sch2 aab"), (3, "ends with sch"), (4, "ends with sch\n"), (5, None), (6, "-sch-sch ")], "id int, c string")
    got = df.select("id", F.explode(text.mentioned(F.col("c"), ["sch", "a.b"])).alias("w"))
    assert sorted(map(tuple, got.collect())) == [(1, "a.b"), (1, "sch"), (3, "sch"), (6, "sch")]
    assert "concat" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sets_of_no_edges_and_of_nulls(spark, tmp_path):
    """The set of all has a row without edges too; tasks of gathered rows grow with the table."""
    for name in ("lineitem", "orders", "supplier"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (rows.limit(0) if name == "lineitem" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [tuple(r) for r in QUERIES["agg_stats_bundle"](spark, str(tmp_path)).select("relation", "period", "n", "companies").collect()] == [(None, None, 0, 0)]


def test_kinds_are_looked_for_once(spark):
    """The kind that a question takes is the one that is returned, looked for in one place of the plan."""
    plan = QUERIES["txt_change_hint"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THEN EXPANDED") == 1 and "exists" not in plan


def test_accounts_fill_all_fields_of_one_list(spark):
    """Eleven fields; the first entry of a list with an amount wins; separate lists count only where there is no consolidated one, whatever that lacks."""
    lists = [
        ("c", 2020, "CFS", "매출액", "-", 0), ("c", 2020, "CFS", "영업 수익", "1,000", 1), ("c", 2020, "CFS", "매출액", "5", 2), ("c", 2020, "CFS", "영업이익(손실)", " (1,234) ", 3),
        ("c", 2020, "CFS", "기말 현금및현금성자산", "7", 4), ("c", 2020, "CFS", "영업활동으로 인한 현금흐름", "8", 5), ("c", 2020, "OFS", "재고자산", "9", 0),
        ("d", 2020, "OFS", "자산총계", "1", 0), ("d", 2020, "OFS", "부채총계", "2", 1), ("d", 2020, "OFS", "자본총계", "3", 2), ("d", 2020, "OFS", "유동자산", "4", 3), ("d", 2020, None, "유동부채", "5", 4),
        ("d", 2020, "OFS", "재고", "6", 5), ("d", 2020, "OFS", "지배기업소유주지분당기순이익", "0", 6), ("e", 2020, "CFS", "Unknown", "1", 0), ("e", 2020, "OFS", "자산총계", "1", 0), ("f", None, "CFS", "매출액", "(x)", 0),
    ]
    out = landing.accounts(spark.createDataFrame(lists, landing.ACCOUNT + ", pos INT"))
    assert out.columns == ["corp_code", "fiscal_year", *landing.ACCOUNTS] and len(landing.ACCOUNTS) == 11
    got = {r.corp_code: {k: v for k, v in r.asDict().items() if v is not None and k in landing.ACCOUNTS} for r in out.collect()}
    assert got == {
        "c": {"revenue": 1000.0, "operating_income": -1234.0, "cash": 7.0, "operating_cf": 8.0},
        "d": {"total_assets": 1.0, "total_liabilities": 2.0, "total_equity": 3.0, "current_assets": 4.0, "current_liabilities": 5.0, "inventory": 6.0, "net_income": 0.0},
    }
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_bundle_has_all_parts(spark, tmp_path):
    """Totals with partners, relations, periods, hubs and bands, over edges without a company, a day or a partner's name, and partners of one name."""
    change = {
        "orders": ("o_custkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN o_orderkey * 1000 ELSE o_custkey END"),
        "lineitem": ("l_shipdate", "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_shipdate END"),
        "supplier": ("s_name", "CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'one' ELSE s_name END"),
    }
    con = duckdb.connect()
    for name, (column, by) in change.items():
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").withColumn(column, F.expr(by)).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["agg_stats_bundle"](spark, str(tmp_path))
    want = con.execute(ORACLE_SQL["agg_stats_bundle"])
    names = [d[0] for d in want.description]
    rows = got.collect()
    assert normal_rows(got.columns, map(tuple, rows)) == normal_rows(names, want.fetchall())
    assert {r.part for r in rows} == {"total", "relation", "period", "hub", "band"} and {"1", "20+"} <= {r.band for r in rows}
    assert [r.partners is None for r in rows if r.part == "total"] == [False]

"""Filing texts, names, financial signals and related companies against hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import filings, financial, graph, leads
from tessera.plans import parted


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_sections_are_cut_at_headings_and_the_next_chapter(spark):
    body = "목차\n1. 사업의 개요\n" + "a" * 40 + "\n\n 2. 주요 제품 및 서비스\nshort\n3. 원재료 및 생산설비\nIII. is said here\n" + "b" * 30 + "\n7. 기타 참고사항\n" + "c" * 30 + "\nIV. 감사\nrest 1. not a heading"
    rows = spark.createDataFrame([(1, body), (2, "1. 사업의 개요\nshort"), (3, None), (4, ""), (5, "x" * 200)], "id int, body string")
    found = {(r.id, r.code): (r.title, r.content, r.n) for r in filings.sections(rows, "id", "body").collect()}
    overview, etc = "1. 사업의 개요\n" + "a" * 40, "7. 기타 참고사항\n" + "c" * 30
    middle = "3. 원재료 및 생산설비\nIII. is said here\n" + "b" * 30
    assert found == {(1, "overview"): ("사업의 개요", overview, len(overview)), (1, "materials"): ("원재료 및 생산설비", middle, len(middle)), (1, "etc"): ("기타 참고사항", etc, len(etc)), (1, "products"): ("주요 제품 및 서비스", "2. 주요 제품 및 서비스\nshort", 20)}


def test_chapter_begins_at_the_second_match_and_ends_at_the_nearest_end(spark):
    body = "II. 사업의 내용\n" + "w" * 400
    assert one(spark, "II. 사업의 내용 ... 3\nIII. 재무 ... 9\n" + body + "\nIII. 재무에\nIV. x", filings.chapter) == body
    assert one(spark, body, filings.chapter) == body  # one match, no end
    assert one(spark, body[:200], filings.chapter) is None and one(spark, "none " * 100, filings.chapter) is None and one(spark, None, filings.chapter) is None
    long = one(spark, "II. 사업의 내용 " + "w" * 90_000, filings.chapter)
    assert len(long) == 80_000 + len(filings.CUT_MARKER) and long.endswith(filings.CUT_MARKER)
    assert one(spark, "제 2 장 사업의 내용 " + "w" * 20 + " IV. " + "w" * 400 + " 4. 감사", filings.chapter).endswith("w")  # an end within 50 characters doesn't count; the later of another pattern does


RELATION_ROWS = [
    ("주요 고객 현황\nAlpha Corp  30%\n(주)Beta\t20%\n12.5\nALPHA CORP | 1\n\nGamma after the list", {("customer", "Alpha Corp"), ("customer", "Beta")}),
    ("핵심 공급사: Gamma, Delta (metal, wood), 기타 등", {("supplier", "Gamma"), ("supplier", "Delta")}),
    ("가. 국내외 경쟁업체\n① Zeta Works\n(단위: 억원)\n2023년 기준\n표 1\n----\n한빛전자", {("competitor", "Zeta Works"), ("competitor", "한빛전자")}),
    ("- 전략적 파트너 ： Eta; Theta、Iota", {("partner", "Eta"), ("partner", "Theta"), ("partner", "Iota")}),
    ("원재료 매입 현황\nKappa Steel\n주요 판매처 목록\nLambda\n3. 원재료 및 생산설비\nMu", {("supplier", "Kappa Steel"), ("customer", "Lambda")}),
    ("고 객 사 명단\nNu Corp", {("customer", "Nu Corp")}),
    ("당사는 주요 고객 현황을 다음 장에서 자세히 설명하고 있으며 그 내용은 아래의 표와 같습니다\nXi", set()),
    ("고객을 위한 서비스\nOmicron", set()),
    ("주요 거래처\n" + "\n".join(f"Name {k}" for k in range(40)), {("customer", f"Name {k}") for k in range(30)}),
    ("", set()), (None, set()), ("주요 고객:", set()),
]


def test_relations_of_tables_and_lists(spark):
    rows = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(RELATION_ROWS)], "id int, body string")
    found = {}
    for r in filings.relations(rows, "id", "body").collect():
        found.setdefault(r.id, set()).add((r.relation, r.name))
    for i, (body, want) in enumerate(RELATION_ROWS):
        assert found.get(i, set()) == want, body
    context = {r.name: r.context for r in filings.relations(rows.filter("id < 2"), "id", "body").collect()}
    assert context == {"Alpha Corp": "주요 고객 현황 Alpha Corp  30%", "Beta": "주요 고객 현황 (주)Beta\t20%", "Gamma": "핵심 공급사: Gamma, Delta (metal, wood), 기타 등 Gamma, Delta (metal, wood), 기타 등", "Delta": "핵심 공급사: Gamma, Delta (metal, wood), 기타 등 Gamma, Delta (metal, wood), 기타 등"}


def test_relations_by_own_words(spark):
    rows = spark.createDataFrame([(1, "Main banks:\nRho, Sigma\n\nMain banks: Tau, Upsilon")], "id int, body string")
    found = {(r.relation, r.name) for r in filings.relations(rows, "id", "body", {"bank": ["banks"]}, ["Main"], ["list"]).collect()}
    assert found == {("bank", x) for x in ("Rho", "Sigma", "Tau", "Upsilon")}


def test_names_lose_their_legal_forms(spark):
    assert one(spark, "주식회사 한빛 (주)", text.normalise_partner) == "한빛"
    assert one(spark, "한빛화학 (HB Chem)", text.normalise_partner) == "한빛화학"
    assert one(spark, "국립 대학교", text.normalise_partner) == "국립" and one(spark, None, text.normalise_partner) is None
    assert one(spark, " (주) 한 빛\t㈜", text.normalise_corp) == "한빛" and one(spark, None, text.normalise_corp) == ""
    assert one(spark, "① (주)한빛 (국내), ", text.clean_partner) == "한빛" and one(spark, "", text.clean_partner) == ""


def year(n, revenue=1000, op=100, net=50, ocf=50, liab=500, equity=500, assets=1000, current=400, cash=100, stock=100):
    return (1, n, revenue, op, net, ocf, liab, equity, assets, current, cash, stock)


def signals(spark, *years):
    rows = spark.createDataFrame(list(years), "corp_code long, fiscal_year int, " + ", ".join(f"{x} long" for x in financial.FIGURES))
    return {r.fiscal_year: r.signals for r in financial.signals(rows).collect()}


def test_signals_of_hand_made_years(spark):
    assert signals(spark, year(2000)) == {2000: []}
    assert signals(spark, year(2000), year(2001)) == {2000: [], 2001: []}
    worse = signals(spark, year(2000), year(2001, op=-10, net=-100, ocf=-150, cash=70, liab=700, equity=300, stock=400))[2001]
    assert worse == ["DAYS_RISK", "EQUITY_ERODES", "FUNDS_RISK", "LIQUIDITY_AND_LEVERAGE", "OPERATING_LOSS", "ROE_FALLS", "RUNWAY_RISK", "STOCK_PILES_UP"]
    turned = signals(spark, year(2000), year(2001, stock=140), year(2002, stock=100, revenue=1100))[2002]
    assert turned == ["STOCK_LEAN", "STOCK_TURNS"]
    assert "QUALITY_WORST" in signals(spark, year(2000, ocf=-1))[2000] and "QUALITY_LOW" in signals(spark, year(2000, ocf=10))[2000] and "CASH_STRONG" in signals(spark, year(2000, cash=300))[2000]
    assert signals(spark, year(2000), year(2001, revenue=None, op=None, net=None, ocf=None, liab=None, equity=None, assets=None, current=None, cash=None, stock=None))[2001] == []


def test_impact_has_four_classes(spark):
    edges = spark.createDataFrame([(1, 2, "customer"), (1, 3, "supplier"), (1, 4, "partner"), (5, 1, "supplier"), (6, 1, "customer"), (7, 8, "supplier")], "corp_code int, partner_id int, relation string")
    classes = {("own", "customer"): "C", ("own", "supplier"): "S", ("other", "supplier"): "D", ("other", "customer"): "R"}
    assert {tuple(r) for r in graph.impact(edges, 1, classes).collect()} == {("C", 2), ("S", 3), ("D", 5), ("R", 6)}


def test_related_companies_rank_named_chain_and_leading_sectors(spark):
    companies = spark.createDataFrame([(k, f"c{k}", s) for k, s in enumerate("AAABBCDX")], "corp_code int, corp_name string, sector string")
    edges = spark.createDataFrame([(3, 0), (7, 0), (3, 0)], "corp_code int, partner_id int")
    news = spark.createDataFrame([(1, 0, ["steel", "ship"]), (2, 6, [])], "id int, named int, words array<string>")
    words = {"A": ["steel"], "B": ["ship", "shipyard"], "C": ["ste"], "D": ["hip"], "X": ["steel"]}
    rows = leads.related_companies(news, edges, companies, words, ["X"], sectors=2, most=3).collect()
    # B has two hits and leads, A has one and stands before C; the company of sector X goes
    assert sorted((r.id, r["rank"], r.corp_code, r.score, r.reasons) for r in rows) == [(1, 1, 0, 100, ["direct"]), (1, 2, 3, 60, ["supply chain"]), (1, 3, 1, 30, ["sector"]), (2, 1, 6, 100, ["direct"])]


def test_texts_in_two_parts(spark):
    docs = spark.createDataFrame([(1, "A station. No hit!\nMotion ends? Last"), (2, ""), (3, None), (4, "none here")], "id long, text string")
    lead, rest = parted.parted()
    assert {r["id"]: (r["a"], r["b"]) for r in docs.select("id", lead.alias("a"), rest.alias("b")).collect()} == {
        1: ("A station. Motion ends", "No hit. Last"), 2: ("", ""), 3: ("", ""), 4: ("", "none here")
    }

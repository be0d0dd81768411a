"""Articles of drafts with what they are held against, written from the tables, which have no article texts.

A body names its company, its last year's sales (90 to 110 % of them), margin and stock with units, words of direction, and
either the comparison's result or a claim of its own. Evidence is the lead's; the filing is the company's latest with a text, on the draft's day or before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import verification as V
from tessera.operators.relational import as_of, top_per_key

SAYS = ["증가와 개선", "감소와 부진", "증가와 감소"]
BODY = """concat(corp_name, '의 매출 ', CAST(CAST(floor(revenue * (90 + draft_id % 21) / 1000000) AS BIGINT) AS STRING), '만, 이익률 ', CAST(CAST(floor(operating_income * 100 / revenue) AS BIGINT) + draft_id % 7 - 3 AS STRING),
    '%, 재고 ', CAST(inventory AS STRING), '만. ', element_at(array('증가와 개선', '감소와 부진', '증가와 감소'), CAST(draft_id % 3 AS INT) + 1), '. ', CASE WHEN draft_id % 2 = 0 THEN coalesce(result, '') ELSE 'unfounded claims elsewhere' END)"""
EVIDENCE = "concat(title, ' of ', corp_name, ' on ', lead_type, ' with ', CAST(signal_count AS STRING), ' signals')"


def articles(t) -> DataFrame:
    """draft_id, corp_code, body, evidence, ai (the comparison's result), biz (the filing's text), amounts, ratios, last (of the company's figures)."""
    last = top_per_key(t.financials, ["corp_code"], 1, F.desc("fiscal_year")).select("corp_code", "revenue", "operating_income", "inventory")
    leads = t.leads.select(F.col("id").alias("lead_id"), "title", "lead_type", "signal_count", "comparison_id")
    compared = t.comparisons.select(F.col("id").alias("comparison_id"), "result")
    rows = t.drafts.select("draft_id", "lead_id", "corp_code", "created_at").join(leads, "lead_id").join(compared, "comparison_id", "left")
    rows = rows.join(t.companies.select("corp_code", "corp_name"), "corp_code").join(last, "corp_code")
    rows = rows.selectExpr("draft_id", "corp_code", "created_at", f"{BODY} AS body", f"{EVIDENCE} AS evidence", "coalesce(result, '') AS ai")
    filed = t.reports.filter("biz_content IS NOT NULL").select("corp_code", F.to_date("rcept_dt", "yyyyMMdd").alias("filed"), F.col("id").alias("report"), F.col("biz_content").alias("biz"))
    rows = as_of(rows, filed, ["corp_code"], "created_at", "filed", ["report", "biz"], part="year").withColumn("biz", F.coalesce("biz", F.lit("")))
    return rows.join(V.truth(t.financials), "corp_code", "left")


_FIGURES = ", ".join(f"{c}::DOUBLE" for c in V.FIGURES)
_RATIOS = ", ".join(f"round({a}::DOUBLE / nullif({b}, 0) * 100, 4)" for a, b in V.RATIOS.values())
TRUTH_SQL = f"""SELECT corp_code, flatten(list(list_filter([{_FIGURES}], lambda v: v <> 0) ORDER BY k)) AS amounts, flatten(list(list_filter([{_RATIOS}], lambda v: v IS NOT NULL) ORDER BY k)) AS ratios,
    list({{'revenue': revenue, 'operating_income': operating_income, 'net_income': net_income}} ORDER BY k)[1:2] AS last
    FROM (SELECT *, row_number() OVER (PARTITION BY corp_code ORDER BY fiscal_year DESC) AS k FROM financials) WHERE k <= 5 GROUP BY 1"""
ARTICLES_SQL = f"""SELECT r.*, coalesce(f.biz, '') AS biz, amounts, ratios, last FROM (
    SELECT d.draft_id, d.corp_code, d.created_at, corp_name || '의 매출 ' || floor(revenue * (90 + d.draft_id % 21) / 1000000)::BIGINT || '만, 이익률 ' || (floor(operating_income * 100 / revenue)::BIGINT + d.draft_id % 7 - 3)
      || '%, 재고 ' || inventory || '만. ' || ({SAYS})[d.draft_id % 3 + 1] || '. ' || CASE WHEN d.draft_id % 2 = 0 THEN coalesce(c.result, '') ELSE 'unfounded claims elsewhere' END AS body,
      title || ' of ' || corp_name || ' on ' || lead_type || ' with ' || signal_count || ' signals' AS evidence, coalesce(c.result, '') AS ai
    FROM drafts d JOIN leads l ON l.id = d.lead_id LEFT JOIN comparisons c ON c.id = l.comparison_id JOIN companies o ON o.corp_code = d.corp_code
    JOIN (SELECT * FROM financials QUALIFY row_number() OVER (PARTITION BY corp_code ORDER BY fiscal_year DESC) = 1) y ON y.corp_code = d.corp_code) r
  ASOF LEFT JOIN (SELECT corp_code, strptime(rcept_dt, '%Y%m%d') AS filed, arg_max(biz_content, id) AS biz FROM reports WHERE biz_content IS NOT NULL GROUP BY 1, 2) f ON f.corp_code = r.corp_code AND r.created_at >= f.filed
  LEFT JOIN ({TRUTH_SQL}) y ON y.corp_code = r.corp_code"""

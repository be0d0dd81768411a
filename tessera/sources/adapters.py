"""Domain views over the driver tables: filings, relations, leads, articles, news, contacts.

Each view stands twice: as a DataFrame builder, and as the SQL that checks queries over it.
Amounts are whole numbers, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import spread

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
#: The day that stands for now.
AS_OF = "2024-01-31"


def _companies(t) -> DataFrame:
    home = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(home, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey AS corp_code", "c_name AS corp_name", "c_mktsegment AS sector", "r_name AS market", "n_name AS nation",
        "CASE WHEN c_acctbal > 0 THEN lpad(CAST(c_custkey AS STRING), 6, '0') END AS stock_code",
        "concat('https://www.', lower(replace(c_name, '#', '-')), '.example.com/ir') AS hm_url",
        "CAST(floor(c_acctbal) AS BIGINT) AS equity",
    )


def _ordered_lines(t) -> DataFrame:
    """Lines with their orders, joined in tasks whose number grows with the lines, so that what a task sorts doesn't."""
    return spread(t.lineitem, t.lineitem.count(), "l_orderkey").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _edges(t) -> DataFrame:
    lines = _ordered_lines(t)
    return lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS id", "o_custkey AS corp_code", "l_suppkey AS partner_id", "s_name AS partner_name",
        "CASE l_returnflag WHEN 'R' THEN 'customer' WHEN 'A' THEN 'supplier' ELSE 'partner' END AS relation",
        "year(l_shipdate) AS period", "CAST(floor(l_discount * 1000 + 0.5) AS BIGINT) AS pct",
        "concat('share ', CAST(floor(l_discount * 1000 + 0.5) AS BIGINT), '% of sales') AS context",
    )


def _mapping(t) -> DataFrame:
    return t.supplier.selectExpr(
        "s_name AS partner_name", "CASE WHEN s_acctbal > 0 THEN s_suppkey END AS mapped_code", "s_acctbal > 0 AS is_listed",
        "CASE WHEN s_acctbal > 5000 THEN 'exact' WHEN s_acctbal > 0 THEN 'normalised' ELSE 'unlisted' END AS match_type",
    )


def _financials(t) -> DataFrame:
    lines = _ordered_lines(t)
    sums = lines.groupBy(F.col("o_custkey").alias("corp_code"), F.year("o_orderdate").alias("fiscal_year")).agg(
        F.expr("sum(CAST(floor(l_extendedprice) AS BIGINT))").alias("revenue"),
        F.expr("sum(CAST(floor(l_extendedprice * (0.06 - l_discount)) AS BIGINT))").alias("operating_income"),
        F.expr("sum(CAST(floor(l_extendedprice * (0.05 - l_discount)) AS BIGINT))").alias("net_income"),
        F.expr("sum(CAST(floor(l_extendedprice * l_tax * 9) AS BIGINT))").alias("total_liabilities"),
        F.expr("sum(CAST(floor(l_quantity) AS BIGINT))").alias("inventory"),
    )
    return sums.selectExpr(
        "corp_code", "fiscal_year", "revenue", "operating_income", "net_income", "total_liabilities", "inventory",
        "revenue AS total_assets", "revenue - total_liabilities AS total_equity", "revenue div 2 AS current_assets",
        "total_liabilities div 2 AS current_liabilities", "inventory * 100 AS cash", "net_income * 2 - operating_income AS operating_cf",
    )


def _reports(t) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey AS id", "o_custkey AS corp_code", "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE c_name END AS corp_name",
        "concat(year(o_orderdate), '_', element_at(array('q1', 'h1', 'q3', 'annual'), quarter(o_orderdate))) AS report_type",
        "date_format(o_orderdate, 'yyyyMMdd') AS rcept_dt", "CAST(floor(o_totalprice / 100) AS BIGINT) AS n_chars",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS raw_text",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('biz ', o_orderpriority) END AS biz_content",
    )


def _comparisons(t) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey * 10 AS id", "o_custkey AS corp_code", "o_orderkey AS report_id_a", "o_orderkey + 1 AS report_id_b",
        "concat(year(o_orderdate), '_q1') AS type_a", "concat(year(o_orderdate) - 1, '_annual') AS type_b",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'flash' ELSE 'pro' END AS model",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'error' ELSE 'ok' END AS status",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('new ', o_orderpriority, ' expanded') END AS result",
        "o_orderdate AS analyzed_at",
    )


def _leads(t) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS id", "o_custkey AS corp_code", "l_orderkey * 10 AS comparison_id",
        "element_at(array('strategy', 'numeric', 'risk', 'supply', 'market'), month(l_shipdate) % 5 + 1) AS lead_type",
        "1 + l_linenumber % 5 AS severity",
        "CASE l_returnflag WHEN 'N' THEN 'new' WHEN 'A' THEN 'used' ELSE 'archived' END AS status",
        "CASE l_linestatus WHEN 'O' THEN NULL ELSE 'partial' END AS news_status",
        "concat('lead ', l_partkey) AS title", "CAST(l_quantity AS INT) AS signal_count", "l_shipdate AS created_at",
    )


def _drafts(t) -> DataFrame:
    return _leads(t).filter("id % 3 = 0").selectExpr(
        "id AS draft_id", "id AS lead_id", "corp_code", "signal_count * 100 AS char_count",
        "element_at(array('draft', 'approved', 'sent', 'replied'), CAST(id % 4 AS INT) + 1) AS status", "created_at",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 101 END AS score",
    )


def _questionnaires(t) -> DataFrame:
    return _drafts(t).filter("draft_id % 2 = 0").selectExpr(
        "draft_id AS q_id", "draft_id", "lead_id", "corp_code", "element_at(array('pending', 'sent', 'replied'), CAST(draft_id % 3 AS INT) + 1) AS status", "created_at"
    )


def _disclosures(t) -> DataFrame:
    return t.events.selectExpr(
        "event_id AS rcept_no", "user_id AS corp_code", "event_type AS report_type", "ts", "value", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        "element_at(array('merger plan', 'rights issue', 'insider holding', 'other notice'), CAST(event_id % 4 AS INT) + 1) AS report_nm",
    )


def _news(t) -> DataFrame:
    return t.pages.selectExpr(
        "page_id AS id", "url", "regexp_replace(parse_url(url, 'HOST'), '^www\\\\.', '') AS host",
        f"CASE WHEN page_id % 17 = 0 THEN NULL ELSE date_sub(DATE'{AS_OF}', CAST(page_id % 260 - 10 AS INT)) END AS published_at",
        "page_id % 150 + 1 AS corp_code", "substring(regexp_extract(html, '<title>([^<]*)</title>', 1), 1, 60) AS title",
        "element_at(array('T1', 'T2', 'RESEARCH', 'BLOG'), CAST(page_id % 4 AS INT) + 1) AS tier",
        "element_at(array(1.0D, 0.8D, 0.9D, 0.3D), CAST(page_id % 4 AS INT) + 1) AS weight",
    )


def _contacts(t) -> DataFrame:
    return t.customer.selectExpr(
        "c_custkey AS id", "c_custkey AS corp_code",
        "CASE c_custkey % 6 WHEN 0 THEN concat('_phone:', c_custkey) WHEN 1 THEN NULL ELSE "
        "concat(element_at(array('ir', 'info', 'sales', 'hr'), CAST(c_custkey % 4 AS INT) + 1), '@', lower(replace(c_name, '#', '-')), '.example.com') END AS email",
        "element_at(array('verified', 'high', 'medium', 'low', 'guess'), CAST(c_custkey % 5 AS INT) + 1) AS confidence",
        "CAST(c_custkey % 2 AS INT) AS user_verified", "c_custkey % 9 <> 0 AS is_active",
        "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS INT) END AS bounced_count", "c_name AS person",
    )


def _messages(t) -> DataFrame:
    return t.conversations.selectExpr(
        "concat(conv_id, '-', turn) AS msg_id", "conv_id AS thread_id", "turn", "CASE role WHEN 'assistant' THEN 'outbound' ELSE 'inbound' END AS direction", "text AS body",
        "timestamp_seconds(1704067200 + conv_id * 3600 + turn * 5400) AS sent_at",
    )


def _articles(t) -> DataFrame:
    docs = t.documents.join(t.labels, "doc_id", "left")
    return docs.selectExpr("doc_id", "source", "lang", "text", "n_chars", "quality", "toxic")


VIEWS = {
    "companies": _companies,
    "edges": _edges,
    "mapping": _mapping,
    "financials": _financials,
    "reports": _reports,
    "comparisons": _comparisons,
    "leads": _leads,
    "drafts": _drafts,
    "questionnaires": _questionnaires,
    "disclosures": _disclosures,
    "news": _news,
    "contacts": _contacts,
    "messages": _messages,
    "articles": _articles,
}

VIEW_SQL = {
    "companies": """
SELECT c_custkey AS corp_code, c_name AS corp_name, c_mktsegment AS sector, r_name AS market, n_name AS nation,
  CASE WHEN c_acctbal > 0 THEN lpad(c_custkey::VARCHAR, 6, '0') END AS stock_code,
  'https://www.' || lower(replace(c_name, '#', '-')) || '.example.com/ir' AS hm_url, floor(c_acctbal)::BIGINT AS equity
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "edges": """
SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS id, o_custkey AS corp_code, l_suppkey AS partner_id, s_name AS partner_name,
  CASE l_returnflag WHEN 'R' THEN 'customer' WHEN 'A' THEN 'supplier' ELSE 'partner' END AS relation,
  year(l_shipdate)::INT AS period, floor(l_discount * 1000 + 0.5)::BIGINT AS pct,
  'share ' || floor(l_discount * 1000 + 0.5)::BIGINT || '% of sales' AS context
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "mapping": """
SELECT s_name AS partner_name, CASE WHEN s_acctbal > 0 THEN s_suppkey END AS mapped_code, s_acctbal > 0 AS is_listed,
  CASE WHEN s_acctbal > 5000 THEN 'exact' WHEN s_acctbal > 0 THEN 'normalised' ELSE 'unlisted' END AS match_type FROM supplier""",
    "financials": """
SELECT *, revenue AS total_assets, revenue - total_liabilities AS total_equity, revenue // 2 AS current_assets,
  total_liabilities // 2 AS current_liabilities, inventory * 100 AS cash, net_income * 2 - operating_income AS operating_cf FROM (
SELECT o_custkey AS corp_code, year(o_orderdate)::INT AS fiscal_year, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS revenue,
  sum(floor(l_extendedprice * (0.06::DOUBLE - l_discount))::BIGINT)::BIGINT AS operating_income,
  sum(floor(l_extendedprice * (0.05::DOUBLE - l_discount))::BIGINT)::BIGINT AS net_income,
  sum(floor(l_extendedprice * l_tax * 9)::BIGINT)::BIGINT AS total_liabilities, sum(floor(l_quantity)::BIGINT)::BIGINT AS inventory
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
    "reports": """
SELECT o_orderkey AS id, o_custkey AS corp_code, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE c_name END AS corp_name,
  year(o_orderdate) || '_' || (['q1', 'h1', 'q3', 'annual'])[quarter(o_orderdate)] AS report_type,
  strftime(o_orderdate, '%Y%m%d') AS rcept_dt, floor(o_totalprice / 100)::BIGINT AS n_chars,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS raw_text,
  CASE WHEN o_orderkey % 3 = 0 THEN 'biz ' || o_orderpriority END AS biz_content
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "comparisons": """
SELECT o_orderkey * 10 AS id, o_custkey AS corp_code, o_orderkey AS report_id_a, o_orderkey + 1 AS report_id_b,
  year(o_orderdate) || '_q1' AS type_a, (year(o_orderdate) - 1) || '_annual' AS type_b,
  CASE WHEN o_orderkey % 3 = 0 THEN 'flash' ELSE 'pro' END AS model, CASE WHEN o_orderkey % 10 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'new ' || o_orderpriority || ' expanded' END AS result, o_orderdate AS analyzed_at FROM orders""",
    "leads": """
SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS id, o_custkey AS corp_code, l_orderkey * 10 AS comparison_id,
  (['strategy', 'numeric', 'risk', 'supply', 'market'])[month(l_shipdate) % 5 + 1] AS lead_type, 1 + l_linenumber % 5 AS severity,
  CASE l_returnflag WHEN 'N' THEN 'new' WHEN 'A' THEN 'used' ELSE 'archived' END AS status,
  CASE l_linestatus WHEN 'O' THEN NULL ELSE 'partial' END AS news_status, 'lead ' || l_partkey AS title, trunc(l_quantity)::INT AS signal_count,
  l_shipdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "drafts": """
SELECT id AS draft_id, id AS lead_id, corp_code, signal_count * 100 AS char_count, (['draft', 'approved', 'sent', 'replied'])[id % 4 + 1] AS status,
  created_at, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 101 END AS score FROM leads WHERE id % 3 = 0""",
    "questionnaires": """
SELECT draft_id AS q_id, draft_id, lead_id, corp_code, (['pending', 'sent', 'replied'])[draft_id % 3 + 1] AS status, created_at FROM drafts WHERE draft_id % 2 = 0""",
    "disclosures": """
SELECT event_id AS rcept_no, user_id AS corp_code, event_type AS report_type, ts, value, json_extract_string(props, '$.k')::BIGINT AS k,
  (['merger plan', 'rights issue', 'insider holding', 'other notice'])[event_id % 4 + 1] AS report_nm FROM events""",
    "news": f"""
SELECT page_id AS id, url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') AS host,
  CASE WHEN page_id % 17 = 0 THEN NULL ELSE DATE '{AS_OF}' - (page_id % 260 - 10)::INT END AS published_at, page_id % 150 + 1 AS corp_code,
  substr(regexp_extract(html, '<title>([^<]*)</title>', 1), 1, 60) AS title, (['T1', 'T2', 'RESEARCH', 'BLOG'])[page_id % 4 + 1] AS tier,
  ([1.0, 0.8, 0.9, 0.3])[page_id % 4 + 1]::DOUBLE AS weight FROM pages""",
    "contacts": """
SELECT c_custkey AS id, c_custkey AS corp_code, CASE c_custkey % 6 WHEN 0 THEN '_phone:' || c_custkey WHEN 1 THEN NULL ELSE
  (['ir', 'info', 'sales', 'hr'])[c_custkey % 4 + 1] || '@' || lower(replace(c_name, '#', '-')) || '.example.com' END AS email,
  (['verified', 'high', 'medium', 'low', 'guess'])[c_custkey % 5 + 1] AS confidence, (c_custkey % 2)::INT AS user_verified, c_custkey % 9 <> 0 AS is_active,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 4)::INT END AS bounced_count, c_name AS person FROM customer""",
    "messages": """
SELECT conv_id || '-' || turn AS msg_id, conv_id AS thread_id, turn, CASE role WHEN 'assistant' THEN 'outbound' ELSE 'inbound' END AS direction, text AS body,
  make_timestamp(CAST((1704067200 + conv_id * 3600 + turn * 5400) * 1000000 AS BIGINT)) AS sent_at FROM conversations""",
    "articles": """
SELECT doc_id, source, lang, text, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)""",
}

"""Sources as queries: driver rows put into a source's own format, and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators.relational import spread
from tessera.plans.registry import query
from tessera.sources import landing
from tessera.sources.adapters import AS_OF


@query("src_table_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'")
def _(t):
    return t.lineitem.filter("l_shipdate >= TIMESTAMP '2001-01-01'").select("l_orderkey", "l_partkey", "l_quantity")


@query("src_table_exists", "SELECT n_nationkey AS id, 0 AS missing FROM nation")
def _(t):
    absent = landing.table_or_empty(t.spark, "tessera_no_such_table", "id long")
    return t.nation.select(F.col("n_nationkey").alias("id")).join(absent.groupBy("id").count(), "id", "left").select("id", F.coalesce("count", F.lit(0)).cast("int").alias("missing"))


@query("src_filing_api", "SELECT rcept_no::VARCHAR AS rcept_no, corp_code::VARCHAR AS corp_code, report_nm FROM disclosures")
def _(t):
    line = F.to_json(F.struct(F.col("rcept_no").cast("string").alias("rcept_no"), F.col("corp_code").cast("string").alias("corp_code"), "report_nm", F.date_format("ts", "yyyyMMdd").alias("rcept_dt")))
    lines = t.disclosures.select(line.alias("value"))
    return landing.filings(lines.union(lines.filter("value LIKE '%merger%'")).union(lines.limit(1).select(F.lit("{broken").alias("value")))).select("rcept_no", "corp_code", "report_nm")


#: Names under which lists give the fields, blanks and all.
LISTED = {
    "revenue": "영업수익", "operating_income": "영업이익 (손실)", "net_income": "당기순이익(손실)", "total_assets": "자산총계", "total_liabilities": "부채 총계", "total_equity": "Total Equity",
    "current_assets": "유동자산", "current_liabilities": "유동부채", "cash": "기말 현금및현금성자산", "inventory": "재고자산", "operating_cf": "영업활동으로 인한 현금흐름",
}


@query("src_account_api", f"SELECT corp_code::VARCHAR AS corp_code, fiscal_year, {', '.join(f'{c}::DOUBLE AS {c}' for c in LISTED)} FROM financials")
def _(t):
    # A fifth of the companies has no consolidated list. Behind the fields come names that fill nothing, or too late; before them one without an amount.
    own = ["매출액", *LISTED.values(), "매출", "Something Else"]
    names = [*own, "매출액", "현금및현금성자산"]  # the last two in the separate list of those that have both
    alone = F.col("corp_code") % 5 == 0
    values = [F.lit(None), *map(F.col, LISTED), F.when(F.col("revenue").isNotNull(), 1), F.col("cash"), F.when(~alone, F.col("inventory")), F.when(~alone, F.col("revenue"))]
    rows = t.financials.select(F.col("corp_code").cast("string").alias("corp_code"), "fiscal_year", alone.alias("alone"), F.array(*[v.cast("long") for v in values]).alias("values"))
    rows = spread(rows, t.lineitem.count(), "corp_code", "fiscal_year")  # years move, not their entries
    rows = rows.select("corp_code", "fiscal_year", "alone", F.posexplode("values").alias("pos", "v"))
    said = F.format_number(F.abs("v"), 0)
    amount = F.when(F.col("pos") == 0, "-").when(F.col("v") < 0, F.concat(F.lit("("), said, F.lit(")"))).otherwise(said)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1)
    return landing.accounts(rows.select("corp_code", "fiscal_year", F.when(F.col("alone") | (F.col("pos") >= len(own)), "OFS").otherwise("CFS").alias("fs_div"), name.alias("account_nm"), amount.alias("amount"), "pos"))


@query("src_event_api", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    lines = t.events.select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    rows = lines.union(lines).select(F.from_json("value", "event_id LONG, event_type STRING").alias("e")).select("e.*").dropDuplicates(["event_id"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


MEDIA = [("blog.therat.example.net", "T1"), ("ththed.example.org", "T2"), ("thther.example.org", "T2"), ("therea.example.net", "T3")]


NAMES = ["the", "and", "la", "e", "Th", "ou"]


@query("src_news_api", f"""SELECT url, outlet AS tier, min(name) AS name FROM news w JOIN (VALUES {', '.join(map(str, MEDIA))}) m(host, outlet) USING (host) JOIN (SELECT unnest({NAMES}) AS name) n ON contains(title, name)
    WHERE outlet IN ('T1', 'T2') AND (published_at IS NULL OR published_at >= DATE '{AS_OF}' - 90) GROUP BY 1, 2""")
def _(t):
    media = t.spark.createDataFrame(MEDIA, "host string, tier string")
    names = t.spark.createDataFrame([(x,) for x in NAMES], "name string")
    return landing.news_items(t.news.select("url", "title", "host", "published_at"), media, names, AS_OF).select("url", "tier", "name")


@query("src_rss", "SELECT 'item ' || c_custkey AS title, 'http://x.example.com/' || c_custkey AS link FROM customer WHERE c_custkey % 45 <= 30")
def _(t):
    at = F.date_format(F.date_sub(F.lit("2024-01-31").cast("date"), (F.col("c_custkey") % 45).cast("int")), "EEE, dd MMM yyyy")
    item = F.concat(F.lit("<item><title>item "), "c_custkey", F.lit("</title><link>http://x.example.com/"), "c_custkey", F.lit("</link><pubDate>"), at, F.lit(" 00:00:00 +0000</pubDate></item>"))
    again = F.regexp_replace(item, "<pubDate>.*</pubDate>", "<pubDate>Mon, 01 Jan 2001 00:00:00 +0000</pubDate>")
    feed = F.concat(F.lit("<rss><channel>"), item, again, F.lit("</channel></rss>"))
    return landing.rss_items(t.customer.select(feed.alias("value")), "2024-01-31").select("title", "link")


@query("src_web_page", "SELECT page_id, length(html) AS n, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def _(t):
    return t.pages.select("page_id", F.length("html").cast("long").alias("n"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("src_mailbox", "SELECT msg_id FROM messages m WHERE direction = 'inbound' AND EXISTS (SELECT 1 FROM messages o WHERE o.thread_id = m.thread_id AND o.direction = 'outbound')")
def _(t):
    ours = t.messages.filter("direction = 'outbound'").select("thread_id")
    return t.messages.filter("direction = 'inbound'").join(ours, "thread_id", "left_semi").select("msg_id")


@query("src_csv_import", "SELECT lower('X' || c.id || '@Example.com') AS email, CASE WHEN c.id % 2 = 0 THEN c.id END AS corp_code FROM contacts c")
def _(t):
    line = F.concat(F.when(F.col("id") % 2 == 0, F.upper("person")).otherwise("nobody"), F.lit(", X"), F.col("id").cast("string"), F.lit("@Example.com"))
    rows = t.contacts.select(F.from_csv(line, "name STRING, email STRING").alias("r")).select("r.*")
    return landing.imported_contacts(rows, t.companies).select("email", "corp_code")


@query("src_yaml_rules", "SELECT 'R' || n_nationkey AS code, n_name AS label FROM nation")
def _(t):
    line = F.array(F.concat(F.lit("- code: R"), F.col("n_nationkey").cast("string")), F.concat(F.lit("  label: "), "n_name"), F.lit("  # note"))
    rows = t.nation.select("n_nationkey", F.posexplode(line).alias("k", "value")).select((F.col("n_nationkey") * 10 + F.col("k")).alias("n"), "value")
    return landing.parse_rules(rows).select(F.col("r")["code"].alias("code"), F.col("r")["label"].alias("label"))


@query("src_office_docs", "SELECT 'p' || p_partkey AS path, p_name || chr(10) || 'end' AS text FROM part")
def _(t):
    @F.pandas_udf("binary")
    def word(names: pd.Series) -> pd.Series:
        def one(name: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f"<w:document><w:body><w:p><w:r><w:t>{name}</w:t></w:r></w:p><w:p></w:p><w:p><w:t>end</w:t></w:p></w:body></w:document>")
            return out.getvalue()

        return names.map(one)

    return landing.docx_texts(t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), word("p_name").alias("content")))


@query("src_zip_document", "SELECT 'p' || p_partkey AS path, 'Title ' || p_name || ' body &' AS text FROM part")
def _(t):
    @F.pandas_udf("binary")
    def zipped(names: pd.Series) -> pd.Series:
        def one(name: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("b.xml", "<p>body &amp;</p>")
                z.writestr("a.html", f"<h1>Title</h1> {name}".encode("euc-kr"))
            return out.getvalue()

        return names.map(one)

    files = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), zipped("p_name").alias("content"))
    return landing.zip_texts(files)

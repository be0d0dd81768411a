"""Readers of landed files: filings, account lists, feeds, archives, CSV imports and rule files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_html
from tessera.operators.dictionary import containing
from tessera.operators.relational import pick_first

FILING = "rcept_no STRING, corp_code STRING, corp_name STRING, report_nm STRING, rcept_dt STRING"
ACCOUNT = "corp_code STRING, fiscal_year INT, fs_div STRING, account_nm STRING, amount STRING"
#: Account names without blanks, in lower case, by the field that they fill: the reference's (scripts/fetch_financials.py:59-90) and English ones.
ACCOUNTS = {
    "revenue": ["매출액", "수익(매출액)", "영업수익", "매출", "순매출액", "수익", "총매출액", "매출액(수익)", "revenue", "sales"],
    "operating_income": ["영업이익", "영업이익(손실)", "영업손익", "영업이익(영업손실)", "영업손실", "operatingincome", "operatingprofit"],
    "net_income": ["당기순이익", "당기순이익(손실)", "당기순손익", "연결당기순이익", "당기순이익(당기순손실)", "지배기업소유주지분당기순이익", "netincome", "profitfortheyear"],
    "total_assets": ["자산총계", "totalassets"],
    "total_liabilities": ["부채총계", "totalliabilities"],
    "total_equity": ["자본총계", "totalequity"],
    "current_assets": ["유동자산", "currentassets"],
    "current_liabilities": ["유동부채", "currentliabilities"],
    "cash": ["현금및현금성자산", "현금및현금성자산(연결)", "기말현금및현금성자산", "현금및현금등가물", "cashandcashequivalents"],
    "inventory": ["재고자산", "재고", "inventories"],
    "operating_cf": ["영업활동으로인한현금흐름", "영업활동현금흐름", "영업으로부터창출된현금", "cashflowsfromoperatingactivities"],
}


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """The table, or no rows of its schema where it is missing."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def filings(json_lines: DataFrame) -> DataFrame:
    """Filings of a column ``value`` with JSON, each rcept_no once; broken lines go."""
    rows = json_lines.select(F.from_json("value", FILING).alias("f")).select("f.*").filter("rcept_no IS NOT NULL")
    return pick_first(rows, ["rcept_no"], F.col("rcept_dt"), F.col("report_nm"))


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    return filings(spark.read.text(path))


def stream_filings(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.readStream.schema(FILING + ", at TIMESTAMP").json(path)
    return rows.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["rcept_no"])


def accounts(lists: DataFrame) -> DataFrame:
    """Account lists as a row a company and year: the eleven canonical fields of its consolidated list, or of the separate one where there is no other.

    The first entry with an amount fills a field: by its place in the list (column ``pos``) where lists have one, then by the names' order in ACCOUNTS.
    Amounts in brackets are negative. A company and year without any known amount has no row.
    """
    known = [(alias, f, k) for f, names in enumerate(ACCOUNTS.values()) for k, alias in enumerate(names)]
    names = lists.sparkSession.createDataFrame(known, "alias string, field int, prio int")
    bare = F.regexp_replace("amount", r"[\s,]", "")
    amount = F.when(bare.startswith("("), F.regexp_replace(bare, r"^\((.*)\)$", "-$1")).otherwise(bare).try_cast("double")
    whole = F.coalesce(F.col("fs_div") == "CFS", F.lit(False)).cast("int")
    place = F.col("pos").cast("long") if "pos" in lists.columns else F.lit(0).cast("long")
    rows = lists.select("corp_code", "fiscal_year", amount.alias("amount"), whole.alias("whole"), F.lower(F.regexp_replace("account_nm", r"\s", "")).alias("alias"), place.alias("place"))
    rows = rows.join(names, "alias", "left")  # entries without a known name show that there is a list
    # A rank is one whole number, so that all fields' amounts are picked in one aggregate by hash, without a sort of the entries.
    rows = rows.withColumns({"slot": F.when(F.col("amount").isNotNull(), F.col("field") * 2 + F.col("whole")), "rank": F.col("place") * len(known) + F.col("prio")})
    picks = [F.min_by("amount", F.when(F.col("slot") == k, F.col("rank"))).alias(f"of_{k}") for k in range(2 * len(ACCOUNTS))]
    picked = rows.groupBy("corp_code", "fiscal_year").agg(F.max("whole").alias("whole"), *picks)
    fields = [F.when(F.col("whole") == 1, F.col(f"of_{2 * f + 1}")).otherwise(F.col(f"of_{2 * f}")).alias(field) for f, field in enumerate(ACCOUNTS)]
    return picked.select("corp_code", "fiscal_year", *fields).filter(F.coalesce(*ACCOUNTS).isNotNull())


def rss_items(feeds: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Items of RSS documents (column ``value``) of the last days: title, link, published."""
    item = "title STRING, link STRING, pubDate STRING"
    channel = F.from_xml("value", f"channel STRUCT<item: ARRAY<STRUCT<{item.replace(' STRING', ': STRING')}>>>")
    rows = feeds.select(F.explode(channel["channel"]["item"]).alias("i"))
    at = F.try_to_timestamp(F.regexp_replace("i.pubDate", "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    rows = rows.select("i.title", "i.link", at.alias("published"))
    return rows.filter(F.col("published").isNull() | (F.col("published") >= F.date_sub(F.lit(today).cast("date"), days)))


def news_items(items: DataFrame, media: DataFrame, names: DataFrame, today: str, days: int = 90, tiers: Sequence[str] = ("T1", "T2"), shown: Sequence[str] = ("title",)) -> DataFrame:
    """Search results (url, host, published_at, shown columns) of media of the tiers that name a company in a shown column, each URL once, with its first name.

    Results older than days go; undated ones stay. names: (name); any number of them.
    """
    fresh = F.col("published_at").isNull() | (F.col("published_at") >= F.date_sub(F.lit(today).cast("date"), days))
    kept = items.filter(fresh).join(media.filter(F.col("tier").isin(*tiers)), "host")
    first = None
    for column in shown:
        named = containing(kept, column, names, "name").groupBy("text").agg(F.min("name").alias("name"))
        met = kept.join(named, F.col(column) == F.col("text")).select("url", *shown, "tier", "name")
        first = met if first is None else first.unionByName(met)
    return pick_first(first, ["url"], F.col("name"), *shown)


def zip_texts(files: DataFrame, most: int = 64 << 20) -> DataFrame:
    """path, text of binary files (path, content): members of a ZIP archive decoded, stripped of markup, joined.

    A member beyond ``most`` bytes is an error, so that no task is flooded by a bomb.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                parts = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in sorted(z.infolist(), key=lambda x: x.filename):
                        if info.file_size > most:
                            raise ValueError(f"{info.filename} has {info.file_size} bytes")
                        raw = z.read(info)
                        for charset in ("utf-8", "euc-kr", "cp949", "latin-1"):
                            try:
                                parts.append(raw.decode(charset))
                                break
                            except UnicodeDecodeError:
                                continue
                texts.append("\n".join(parts))
            yield pd.DataFrame({"path": batch["path"], "raw": texts})

    return files.select("path", "content").mapInPandas(unpack, "path string, raw string").select("path", strip_html(F.col("raw")).alias("text"))


def docx_texts(files: DataFrame) -> DataFrame:
    """path, text of Word files: paragraphs of the document part."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    texts.append(z.read("word/document.xml").decode("utf-8"))
            yield pd.DataFrame({"path": batch["path"], "raw": texts})

    raw = files.select("path", "content").mapInPandas(unpack, "path string, raw string")
    paragraphs = F.regexp_extract_all("raw", F.lit(r"(?s)<w:p[ >].*?</w:p>"), F.lit(0))
    text = F.array_join(F.filter(F.transform(paragraphs, lambda p: F.regexp_replace(p, "<[^>]+>", "")), lambda p: p != ""), "\n")
    return raw.select("path", text.alias("text"))


def read_zip_texts(spark: SparkSession, path: str) -> DataFrame:
    return zip_texts(spark.read.format("binaryFile").load(path))


def imported_contacts(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """CSV rows (name, email) matched to companies by normalised name."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[\s#.,()-]+", ""))
    names = companies.groupBy(key(F.col("corp_name")).alias("key")).agg(F.min("corp_code").alias("corp_code"))
    return rows.withColumns({"key": key(F.col("name")), "email": F.lower(F.trim("email"))}).join(names, "key", "left").drop("key")


def read_contact_csv(spark: SparkSession, path: str, companies: DataFrame) -> DataFrame:
    return imported_contacts(spark.read.csv(path, header=True, schema="name STRING, email STRING"), companies)


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rules of a flat YAML text (column ``value``, in line order by ``n``): ``- code: X`` begins a rule, ``key: value`` fills it.

    Meant for rule files: one window over a small file.
    """
    begins = F.col("value").rlike(r"^\s*-\s*code:").cast("int")
    rows = lines.withColumn("rule", F.sum(begins).over(Window.partitionBy(F.lit(0)).orderBy("n")))
    pair = rows.select("rule", F.regexp_extract("value", r"^[\s-]*(\w+):\s*(.*?)\s*$", 1).alias("k"), F.regexp_extract("value", r"^[\s-]*(\w+):\s*(.*?)\s*$", 2).alias("v")).filter("rule > 0 AND k <> ''")
    return pair.groupBy("rule").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("r"))

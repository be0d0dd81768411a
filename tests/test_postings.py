"""Postings and what past texts mention, against counting words in every text."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators.postings import first_keywords, past_mentions, write_postings

DOCS = [
    ("a", 1, dt.date(2020, 1, 1), "New chips, new CHIPS and 반도체 반도체"), ("a", 2, dt.date(2021, 5, 1), "chips"), ("a", 3, dt.date(2022, 5, 1), "chips chips"),
    ("b", 4, dt.date(2020, 1, 1), "chips of b"), ("a", 5, None, "undated chips"), ("a", 6, dt.date(2020, 2, 2), None), ("a", 7, dt.date(2020, 2, 2), ""), ("a", 2, dt.date(2021, 5, 1), "chips"),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "corp string, doc int, at date, body string")


def test_terms_are_counted_as_words(spark):
    table = write_postings(docs(spark), ["corp", "doc"], "body", "at")
    want = Counter()
    for corp, doc, at, body in DOCS:
        for w in re.findall("[가-힣]{2,}|[A-Za-z]{3,}", body or ""):
            want[corp, doc, at, w.lower()] += 1
    assert {(r.corp, r.doc, r["at"], r.term): r.n for r in table.collect()} == dict(want)
    assert {r.year for r in table.select("year").distinct().collect()} == {0, 2020, 2021, 2022}


def test_past_mentions_leave_out_what_is_compared(spark):
    table = write_postings(docs(spark), ["corp", "doc"], "body", "at")
    asked = spark.createDataFrame([(10, "a", "chips", [1]), (11, "a", "chips", [2, 3, 99]), (12, "b", "new", []), (13, "a", "반도체", None), (14, None, "chips", []), (15, "a", None, [])], "id int, corp string, keyword string, compared array<int>")
    got = {(r.id, r.keyword): (r.docs, r.mentions, r.since) for r in past_mentions(asked, table, "id", "corp", "doc", "at", "compared").collect()}
    assert got == {(10, "chips"): (3, 5, dt.date(2021, 5, 1)), (11, "chips"): (2, 3, dt.date(2020, 1, 1)), (13, "반도체"): (1, 2, dt.date(2020, 1, 1))}


def test_only_partitions_of_the_terms_are_read(spark, capsys):
    table = write_postings(docs(spark), ["corp", "doc"], "body", "at")
    asked = spark.createDataFrame([(10, "a", "chips", [1])] * 3, "id int, corp string, keyword string, compared array<int>").filter("id = 10")
    past_mentions(asked, table.filter("year >= 2021"), "id", "corp", "doc", "at", "compared").explain("formatted")
    filters = re.search(r"PartitionFilters: \[(.*)\]\nPushedFilters", capsys.readouterr().out)[1]
    assert "year" in filters and re.search(r"dynamicpruningexpression\(part#\d+ IN dynamicpruning", filters)


def test_first_keywords(spark):
    rows = spark.createDataFrame([("Zeta beta ab alpha Beta 한빛 gamma delta",), ("",), (None,)], "x string").select(first_keywords(F.col("x")).alias("y"))
    assert [r["y"] for r in rows.collect()] == [["alpha", "beta", "delta", "gamma", "zeta"], [], None]

"""Hot keys and odd rows: revisits whose responses repeat, and joins back of large groups of copies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, simhash, warc
from tests.llm.test_operators import record

RECORD = "record_id long, url string, s long, kind string, etag string, last_modified string, headers map<string,string>, payload_sha256 string, payload_bytes long"


def resolved(spark, rows):
    df = spark.createDataFrame(rows, RECORD).withColumn("ts", F.timestamp_seconds("s"))
    return sorted(((r["record_id"], r["status"], r["via"], r["response_id"], r["payload_sha256"], r["headers"]) for r in warc.resolve_revisits(df, slices=3).collect()), key=str)


def test_a_response_that_repeats_answers_once(spark):
    once = record(1, "a.com", 10, "response", '"e"', vary="x")
    other = (*once[:6], {"vary": "y"}, "zzz", 9)  # the same URL, time and record_id: the greatest digest stands
    assert resolved(spark, [once, once, record(2, "a.com", 20, etag='"e"')]) == [(2, "resolved", "etag", 1, "sha1", {"vary": "x"})]
    assert resolved(spark, [once, other, once, record(2, "a.com", 20, etag='"e"')]) == [(2, "resolved", "etag", 1, "zzz", {"vary": "y"})]
    again = record(2, "a.com", 20, etag='"e"')
    assert len(resolved(spark, [once, once, again, again])) == 2


def test_responses_without_id_or_headers(spark):
    null_id = (None, "a.com", 10, "response", '"e"', None, {"vary": "x"}, "sha", 5)
    assert resolved(spark, [null_id, record(2, "a.com", 20, etag='"e"')]) == [(2, "resolved", "etag", None, "sha", {"vary": "x"})]
    named = record(1, "a.com", 10, "response", '"f"')
    assert resolved(spark, [null_id, named, record(2, "a.com", 20, etag='"f"')])[0][:4] == (2, "resolved", "etag", 1)
    bare = (1, "a.com", 10, "response", '"e"', None, None, "sha", 5)
    assert resolved(spark, [bare, record(2, "a.com", 20, etag='"e"', vary="new", content_type="no")]) == [(2, "resolved", "etag", 1, "sha", {"vary": "new"})]
    assert resolved(spark, [record(1, "a.com", 10, "response", '"e"', vary="x"), (2, "a.com", 20, "revisit", '"e"', None, None, None, None)])[0][5] == {"vary": "x"}


@pytest.fixture
def half_equal(spark):
    """20,000 rows, half of them one text, some of those without an id."""
    text = F.when(F.col("id") % 2 == 0, "one text that many rows share").otherwise(F.concat(F.lit("text of its own "), F.col("id").cast("string")))
    return spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("doc_id"), text.alias("text")).repartition(40)


def test_exact_copies_of_half_a_table(spark, half_equal):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exact_dedup.duplicate_report(half_equal, salts=32)
        per = {(r["group_size"], r["kept"]): r["n"] for r in found.groupBy("group_size", "kept").agg(F.count("*").alias("n")).collect()}
        assert per == {(10_000, False): 9_999, (10_000, True): 1, (1, True): 10_000}
        kept = found.filter("group_size > 1").select("keep_id").distinct().collect()
        assert [r["keep_id"] for r in kept] == [19_998]
        # by salt, the hot text is dealt evenly, its null ids by the task that read them
        light = half_equal.filter("text LIKE 'one%'").select(exact_dedup._salt(32).alias("s")).groupBy("s").count()
        sizes = sorted(r["count"] for r in light.collect())
        assert len(sizes) == 32 and sizes[-1] <= 3 * sizes[16]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_colliding_digests_of_hot_texts(half_equal):
    got = exact_dedup.duplicate_report(half_equal, salts=8, digest=lambda t: F.substring(t, 1, 4))
    want = exact_dedup.duplicate_report(half_equal, salts=8)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_fingerprints_of_half_a_table(half_equal):
    got = simhash.near_duplicates(half_equal.filter("doc_id IS NOT NULL"))
    hot = got.filter("component_id = 2").select("fingerprint").distinct().count()
    assert got.count() == 18_000 and hot == 1
    assert got.groupBy("component_id").count().agg(F.max("count")).first()[0] >= 8_000

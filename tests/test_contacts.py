"""Contact blocks, names and replies against hand-made mails, and the state of replies over batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import contact
from tessera.streaming import jobs


def signed(spark, said):
    return tuple(spark.createDataFrame([(said,)], "x string").select(contact.signature(contact.contact_block(F.col("x"))).alias("y")).first()["y"])


def test_signatures(spark):
    assert signed(spark, "hello\n■ 문의처: 홍보팀 김철수 팀장 010-1234-5678, 02-555-1234 ir@corp.com ir@corp.com") == ("김철수", "팀장", "홍보팀", "010-1234-5678", "02-555-1234", "ir@corp.com")
    assert signed(spark, "IR본부 남궁민수(부장) tel 031.345.6789 noreply@x.com pr@corp.co.kr") == ("남궁민수", "부장", "IR본부", None, "031-345-6789", "pr@corp.co.kr")
    assert signed(spark, "김철수팀장") == ("김철수", "팀장", None, None, None, None)
    assert signed(spark, "최고 책임, 띄어 과장, Admin@x.com") == (None, None, None, None, None, None)  # a common word; no surname; a machine's address
    assert signed(spark, "") == signed(spark, None) == (None,) * 6


def test_the_block_begins_at_its_sign_or_near_the_end(spark):
    def block(said):
        return spark.createDataFrame([(said,)], "x string").select(contact.contact_block(F.col("x")).alias("y")).first()["y"]

    assert block("a" * 2000 + "문의: b" + "c" * 3000) == "문의: b" + "c" * 1495
    assert block("a" * 10 + "b" * 1500) == "b" * 1500 and block("short") == "short"


@pytest.mark.parametrize("body,points", [("x" * 99, 9), ("x" * 5000, 100), ("비공개" + "x" * 600, 30), ("답변 어렵", 0), ("", 0)])
def test_quality(spark, body, points):
    assert spark.createDataFrame([(body,)], "x string").select(contact.reply_quality(F.col("x")).alias("y")).first()["y"] == points


SCHEMA = "thread_id long, msg_id string, sent_at timestamp, direction string, quality int, " + ", ".join(f"{f} string" for f in jobs.FIELDS)


def message(thread, n, hours, direction="inbound", quality=10, name=None, phone=None):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hours)
    return (thread, f"{thread}-{n}", at, direction, quality, name, None, None, None, phone, None)


def learned(spark, tmp_path, *batches):
    """What is known after each batch is landed as a file and taken by itself."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = jobs.run_backlog(jobs.learn_replies(stream, "thread_id"), "update", ["thread_id"])
    return {r["thread_id"]: (r["replies"], r["avg_days"], r["quality"], r["name"], r["phone"]) for r in found.collect()}


FIRST = [message(1, 0, 0, "outbound"), message(1, 1, 12, quality=20, name="kim"), message(2, 0, 1), message(3, 0, 2, "outbound")]
SECOND = [message(1, 2, 36, quality=41, name="lee", phone="02"), message(2, 1, 5, "outbound"), message(2, 2, 29, quality=90)]
KNOWN = {1: (2, 1.0, 30, "kim", "02"), 2: (2, 1.0, 50, None, None)}


def test_replies_in_one_batch(spark, tmp_path):
    assert learned(spark, tmp_path, FIRST + SECOND) == KNOWN


def test_two_batches_equal_one_and_a_replay_changes_nothing(spark, tmp_path):
    assert learned(spark, tmp_path / "two", FIRST, SECOND) == KNOWN
    assert learned(spark, tmp_path / "again", FIRST, FIRST, SECOND, SECOND, FIRST) == KNOWN


def test_silent_contacts_are_forgotten(spark, tmp_path):
    late = [message(1, 3, 24 * 400, quality=70)]
    moves = [message(9, 0, 24 * 399)], [message(9, 1, 24 * 399 + 1)]
    got = learned(spark, tmp_path, FIRST, SECOND, *moves, late)
    assert got[1] == (1, None, 70, None, None)


def test_no_messages(spark, tmp_path):
    assert learned(spark, tmp_path, []) == {}

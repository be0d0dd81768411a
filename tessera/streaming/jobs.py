"""Structured Streaming jobs: streaming DataFrame in, streaming DataFrame out, and a runner for backlogs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.lineage import shared_base
from tessera.operators.relational import pick_first

#: How late a row may be.
LATENESS = "24 hours"


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, one file or a folder of them, as a file stream; times without zone are UTC."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path}*")  # a pattern, as a stream's path can't be one file
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_backlog(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """All that is there now, through the stream, as a table.

    Batches are written under their number, so a batch that is run again replaces itself. In
    update mode the last row of each key stands.
    """
    spark = stream.sparkSession
    path = f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(f"{path}/out")
    if mode == "update":
        rows = pick_first(rows, keys, -F.col("batch"))
    return rows.drop("batch")


def dedup_messages(messages: DataFrame) -> DataFrame:
    """Each msg_id once, while its first copy is within the lateness."""
    return messages.withWatermark("sent_at", LATENESS).dropDuplicatesWithinWatermark(["msg_id"])


def thread_matches(inbound: DataFrame, outbound: DataFrame, within: str = "7 days") -> DataFrame:
    """Inbound messages of threads in which we wrote before, within a time; both sides' state is bounded by it."""
    ours = outbound.withWatermark("out_at", LATENESS)
    theirs = inbound.withWatermark("sent_at", LATENESS)
    on = F.expr(f"thread_id = out_thread AND sent_at >= out_at AND sent_at <= out_at + INTERVAL {within}")
    return theirs.join(ours, on, "inner")


def day_counters(events: DataFrame, *keys: str) -> DataFrame:
    """Counts per day and key."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", LATENESS).groupBy(day.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), *keys, "n")


def rolling_counts(events: DataFrame, length: str, step: str, *keys: str) -> DataFrame:
    window = F.window("ts", length, step)
    return events.withWatermark("ts", LATENESS).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("from_ts"), *keys, "n")


def mark_repeats(events: DataFrame, hours: int = 24) -> DataFrame:
    """event_id, user_id, repeat: whether the user's event before it is less than ``hours`` old.

    State is one time a user, and goes when it is too old to matter. Rows of times up to
    1970-01-01 00:00 UTC, where the watermark begins, are late from the start and go.
    """

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        micros = rows["ts"].astype("datetime64[us]").astype("int64")
        before = micros.shift(1)
        if state.exists:
            before.iloc[0] = state.get[0]
        gap = micros - before
        last = int(micros.iloc[-1])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "repeat": (gap < hours * 3_600_000_000).fillna(False)})

    groups = events.withWatermark("ts", LATENESS).groupBy("user_id")
    return groups.applyInPandasWithState(mark, "event_id long, user_id long, repeat boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


#: What is known of a contact: numbers, and the fields of a signature, each as it first came.
LEARNED = "first_sent long, replies long, timed long, days double, quality long, last_reply long, name string, title string, dept string, mobile string, phone string, email string"
FIELDS = ["name", "title", "dept", "mobile", "phone", "email"]
STATS = "replies long, avg_days double, quality int, last long, fields array<string>"


def learn_replies(messages: DataFrame, key: str, keep: str = "180 days") -> DataFrame:
    """For each key whose messages come, what its replies say so far: replies, avg_days from our first message, quality, last_reply and signature.

    messages: key, msg_id, sent_at, direction (inbound or outbound), quality (of an inbound body), and FIELDS of its signature. A message
    that comes twice counts once, while its first copy is within the lateness. State is one row a key, and goes when the key was silent for
    ``keep``. Rows of a batch are taken in the order of their time, so batches in that order give what one batch of all gives.
    """
    kind = messages.schema[key].dataType.simpleString()
    patience = int(pd.Timedelta(keep).total_seconds() * 1000)

    def learn(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, replies, timed, days, quality, last, *fields = state.get if state.exists else (None, 0, 0, 0.0, 0, None, *[None] * len(FIELDS))
        rows = [r for b in batches for r in zip(*(b[c].tolist() for c in ("at", "msg_id", "direction", "quality", "fields")))]  # a key has few rows: lists are cheaper than frames
        newest = 0
        for at, _, direction, points, news in sorted(rows, key=lambda r: r[:2]):
            newest = max(newest, at)
            if direction == "outbound":
                first = at if first is None else min(first, at)
                continue
            replies, quality, last = replies + 1, quality + int(points), max(last or at, at)
            if first is not None and at >= first:
                timed, days = timed + 1, days + (at - first) / 86_400_000_000
            fields = [old if old is not None else new if isinstance(new, str) else None for old, new in zip(fields, news)]
        state.update((first, replies, timed, days, quality, last, *fields))
        state.setTimeoutTimestamp(max(newest // 1000 + patience, state.getCurrentWatermarkMs() + 1))
        if replies:
            yield pd.DataFrame([(k[0], replies, days / timed if timed else None, quality // replies, last, fields)], columns=[key, "replies", "avg_days", "quality", "last", "fields"])

    once = messages.withWatermark("sent_at", LATENESS).dropDuplicatesWithinWatermark([key, "msg_id"])
    rows = once.select(key, "sent_at", F.unix_micros("sent_at").alias("at"), "msg_id", "direction", "quality", F.array(*FIELDS).alias("fields"))
    found = rows.groupBy(key).applyInPandasWithState(learn, f"{key} {kind}, {STATS}", LEARNED, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(key, "replies", "avg_days", "quality", F.timestamp_micros("last").alias("last_reply"), *[F.get("fields", F.lit(i)).alias(f) for i, f in enumerate(FIELDS)])

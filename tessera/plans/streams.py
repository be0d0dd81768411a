"""Streaming jobs over the driver tables, run over the backlog; their SQL is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.relational import top_per_key
from tessera.plans.registry import query
from tessera.streaming import jobs


def events(t):
    return jobs.read_table_stream(t.spark, t.sf_dir, "events")


def messages(t):
    rows = jobs.read_table_stream(t.spark, t.sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 5400)
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("msg_id"), F.col("conv_id").alias("thread_id"), F.when(F.col("role") == "assistant", "outbound").otherwise("inbound").alias("direction"), at.alias("sent_at"))


@query("st_dedup_msg", "SELECT DISTINCT msg_id, thread_id FROM messages")
def _(t):
    twice = messages(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return jobs.run_backlog(jobs.dedup_messages(twice).select("msg_id", "thread_id"))


@query("st_thread_match", "SELECT DISTINCT i.msg_id FROM messages i JOIN messages o ON i.thread_id = o.thread_id AND o.direction = 'outbound' AND i.sent_at >= o.sent_at AND i.sent_at <= o.sent_at + INTERVAL 7 DAY WHERE i.direction = 'inbound'")
def _(t):
    inbound = messages(t).filter("direction = 'inbound'")
    outbound = messages(t).filter("direction = 'outbound'").select(F.col("thread_id").alias("out_thread"), F.col("sent_at").alias("out_at"))
    return jobs.run_backlog(jobs.thread_matches(inbound, outbound).select("msg_id")).distinct()


@query("st_day_counters", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return jobs.run_backlog(jobs.day_counters(events(t), "event_type"), "update", ["day", "event_type"])


@query("st_daily_quota", "SELECT user_id, day, least(n, 4) AS allowed, greatest(n - 4, 0) AS blocked FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def _(t):
    per = jobs.run_backlog(jobs.day_counters(events(t), "user_id"), "update", ["day", "user_id"])
    return per.select("user_id", "day", F.least(F.col("n"), F.lit(4)).alias("allowed"), F.greatest(F.col("n") - 4, F.lit(0)).alias("blocked"))


@query("st_rolling_disclosures", "SELECT to_timestamp(d * 86400)::TIMESTAMP AS from_ts, event_type, count(*) AS n FROM (SELECT event_type, unnest(range((ts::DATE - DATE '1970-01-01') - 6, (ts::DATE - DATE '1970-01-01') + 1)) AS d FROM events) GROUP BY 1, 2")
def _(t):
    return jobs.run_backlog(jobs.rolling_counts(events(t), "7 days", "1 day", "event_type"), "update", ["from_ts", "event_type"])


@query("st_dup_window", "SELECT event_id, user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 86400000000, false) AS repeat FROM events")
def _(t):
    return jobs.run_backlog(jobs.mark_repeats(events(t).select("event_id", "user_id", "ts")))


@query("st_collect_cache", "SELECT event_id FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap >= 21600000000")
def _(t):
    marked = jobs.run_backlog(jobs.mark_repeats(events(t).select("event_id", "user_id", "ts"), hours=6))
    return marked.filter("NOT repeat").select("event_id")


@query("st_poll", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    rows = jobs.run_backlog(events(t).select("event_id", "event_type"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("st_incremental", "SELECT id FROM comparisons c WHERE status = 'ok' AND NOT EXISTS (SELECT 1 FROM drafts d WHERE d.lead_id // 800000000 = c.id // 10)")
def _(t):
    done = t.drafts.select(F.expr("(lead_id div 800000000) * 10").alias("id"))
    return t.comparisons.filter("status = 'ok'").select("id").join(done, "id", "left_anti")


@query("st_checkpoint", "SELECT source, max(doc_id) AS upto, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    rows = jobs.run_backlog(jobs.read_table_stream(t.spark, t.sf_dir, "documents").select("source", "doc_id"))
    return rows.groupBy("source").agg(F.max("doc_id").alias("upto"), F.count("*").alias("n"))


@query("st_late", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1")
def _(t):
    newest = t.events.agg(F.max("ts").alias("newest"))  # one row
    rows = t.events.join(F.broadcast(newest)).filter("ts >= newest - INTERVAL 24 HOURS")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("st_latest_event", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def _(t):
    return top_per_key(t.events.select("user_id", "event_id", "ts"), ["user_id"], 3, F.desc("ts"), F.col("event_id")).drop("ts")


@query("st_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap >= 3600000000 GROUP BY 1")
def _(t):
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = gap - F.lag(gap).over(by_user)
    return t.events.withColumn("gap", gap).filter("gap IS NULL OR gap >= 3600000000").groupBy("user_id").agg(F.count("*").alias("sessions"))

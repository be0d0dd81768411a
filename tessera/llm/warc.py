"""WARC revisits: not-modified records resolved to the response that they stand for.

A revisit of the profile server-not-modified has no payload. It stands for the latest full
response to the same canonical URL that was captured strictly earlier (of equal times, the
greatest record_id). That response is accepted if a validator agrees: ETags by weak
comparison where both have one, else Last-Modified where both have one. The resolved record
has the response's headers, overlaid with those that a 304 answer may update.

The as-of join is one union and window over (URL, slice). Slices are ranges of all records in
the order of time, kind and record_id, about ``SLICE_ROWS`` records each, so a URL with any
share of the rows is dealt to many tasks, even if all its captures are of one time; the last
response of earlier slices is carried in by a window over one row for each URL and slice.

Status: ``resolved``, ``mismatch`` (a validator differs), ``unverified`` (none to compare) or
``orphan`` (no earlier response). Only resolved revisits get response_id, payload figures and
headers.

Behaviour: a null URL matches nothing (orphan). A null time is before all others. Revisits that
repeat are answered each, and once each: of responses with one URL, time and record_id the one with
the greatest digest stands. A response with a null record_id is one like any other, ranks behind those
of its time that have one, and shows as a null response_id. Null headers are none. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

#: Headers of a 304 answer that update the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change what a URL shows.
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
#: Records that a slice is meant for, and slices at least.
SLICE_ROWS, LEAST_SLICES = 100_000, 64


def canonical_url(url: Column) -> Column:
    """Scheme, www., default port, fragment, tracking parameters and trailing slash dropped; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_extract(F.regexp_replace(bare, r"^[^/?]*", ""), r"^[^?]*", 0)
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), TRACKING, ""), "^&+", "")
    return F.concat(host, F.when(query == "", F.regexp_replace(path, r"/$", "")).otherwise(F.concat(path, F.lit("?"), query)))


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """A row for each revisit of records.

    records: record_id long, url string, ts timestamp, kind ('response' or 'revisit'), etag and
    last_modified string, headers map of lower-case names, payload_sha256 string, payload_bytes long.
    """
    own = records.select(
        "record_id", "url", canonical_url(F.col("url")).alias("canonical"), F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))).alias("at"), "ts",
        (F.col("kind") == "response").alias("full"), "etag", "last_modified", "headers", "payload_sha256", "payload_bytes",
    )
    slices = slices or max(LEAST_SLICES, -(-records.count() // SLICE_ROWS))
    # at equal times revisits stand first: a response of the same time is not earlier
    own = durable(own.repartitionByRange(slices, "at", "full", "record_id").withColumn("slice", F.spark_partition_id()), "captures")

    response = F.when(F.col("full"), F.struct("at", "record_id", "etag", "last_modified", "headers", "payload_sha256", "payload_bytes"))
    light = own.withColumn("response", F.when(F.col("full"), F.struct("at", "record_id")))
    last = light.groupBy("canonical", "slice").agg(F.max("response").alias("last"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = durable(last.select("canonical", "slice", F.last("last", ignorenulls=True).over(before).alias("carried")).filter("carried IS NOT NULL"), "carried")
    seen = Window.partitionBy("canonical", "slice").orderBy("at", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = light.withColumn("near", F.last("response", ignorenulls=True).over(seen)).filter("NOT full AND canonical IS NOT NULL")
    pointed = near.join(carried, ["canonical", "slice"], "left").withColumn("to", F.coalesce("near", "carried")).drop("near", "carried", "response")
    pointed = pointed.unionByName(own.filter("NOT full AND canonical IS NULL").withColumn("to", F.lit(None).cast("struct<at:bigint,record_id:bigint>")))

    digest = F.struct("payload_sha256", "etag", "last_modified", "payload_bytes", F.to_json("headers"))
    full = own.filter("full AND canonical IS NOT NULL").groupBy(F.col("canonical").alias("of_url"), F.col("at").alias("of_at"), F.col("record_id").alias("of"))
    full = full.agg(F.max_by(response, digest).alias("r"))  # a response that repeats answers once
    both = pointed.join(full, F.col("to.record_id").eqNullSafe(F.col("of")) & (F.col("canonical") == F.col("of_url")) & (F.col("to.at") == F.col("of_at")), "left")

    def weak(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    agrees = F.coalesce(weak(F.col("etag")) == weak(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified"))
    via = F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), "etag").when(F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull(), "last-modified")
    status = F.when(F.col("of_at").isNull(), "orphan").when(agrees, "resolved").when(agrees.isNull(), "unverified").otherwise("mismatch")
    none = F.create_map().cast("map<string,string>")
    update = F.map_filter(F.coalesce("headers", none), lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.coalesce("r.headers", none), lambda k, v: ~F.array_contains(F.map_keys(F.col("update")), k)), F.col("update"))
    ok = F.col("status") == "resolved"
    return (
        both.withColumns({"status": status, "via": via, "update": update})
        .withColumn("merged", F.when(ok, merged))
        .select(
            "record_id", "url", F.col("canonical").alias("canonical_url"), "ts", "status", F.when(F.col("of_at").isNotNull(), F.col("via")).alias("via"),
            F.when(ok, F.col("of")).alias("response_id"), F.when(ok, F.col("r.payload_sha256")).alias("payload_sha256"),
            F.when(ok, F.col("r.payload_bytes")).alias("payload_bytes"), F.col("merged").alias("headers"),
        )
    )


def capture_log(pages: DataFrame) -> DataFrame:
    """An archive's records made from pages: each page once in full, and revisits of it of every sort.

    A page is captured page_id minutes into 2024. Revisits come a week later with the page's
    ETag; where page_id divides by 3 with a weak one under another form of the URL, by 5 an
    hour before the page itself, by 7 with another ETag, by 11 with Last-Modified alone, by 13
    with no validator.
    """
    sha, tag = F.sha2(F.coalesce("html", F.lit("")), 256), F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    minute = 60
    base = pages.select(
        "page_id", "url", sha.alias("payload_sha256"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_bytes"), tag.alias("tag"),
        (F.lit(1704067200) + F.col("page_id") * minute).alias("s"),
    )
    week, form = 7 * 86400, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))

    def entry(k: int, delay: int, url: Column, etag: Column, modified: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(k).alias("k"), F.lit(delay).alias("delay"), url.alias("at_url"), etag.alias("etag"), modified.alias("last_modified")))

    def every(n: int) -> Column:
        return F.col("page_id") % n == 0

    none, modified = F.lit(None).cast("string"), F.concat(F.lit("t"), F.col("s").cast("string"))
    entries = F.array(
        entry(0, 0, F.col("url"), F.col("tag"), modified, F.lit(True)),
        entry(1, week, F.col("url"), F.col("tag"), none, F.lit(True)),
        entry(2, week + 1, form, F.concat(F.lit("W/"), F.col("tag")), none, every(3)),
        entry(3, -3600, F.col("url"), F.col("tag"), none, every(5)),
        entry(4, week + 2, F.col("url"), F.lit('"other"'), modified, every(7)),
        entry(5, week + 3, F.col("url"), none, modified, every(11)),
        entry(6, week + 4, F.col("url"), none, none, every(13)),
    )
    rows = base.withColumn("e", F.explode(F.array_compact(entries))).select("page_id", "url", "payload_sha256", "payload_bytes", "s", "e.*")
    full = F.col("k") == 0
    now = F.col("s") + F.col("delay")
    headers = F.map_filter(
        F.create_map(
            F.lit("content-type"), F.when(full, "text/html").otherwise("text/plain"), F.lit("date"), now.cast("string"), F.lit("etag"), F.col("etag"),
            F.lit("last-modified"), F.col("last_modified"), F.lit("vary"), F.when(F.col("k") == 2, "accept"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select(
        (F.col("page_id") * 8 + F.col("k")).alias("record_id"), F.col("at_url").alias("url"), F.timestamp_seconds(now).alias("ts"),
        F.when(full, "response").otherwise("revisit").alias("kind"), "etag", "last_modified", headers.alias("headers"),
        F.when(full, F.col("payload_sha256")).alias("payload_sha256"), F.when(full, F.col("payload_bytes")).alias("payload_bytes"),
    )


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved log; headers as sorted ``name: value`` lines, times in seconds."""
    found = resolve_revisits(capture_log(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select("record_id", "url", "canonical_url", F.unix_seconds("ts").alias("captured"), "status", "via", "response_id", "payload_sha256", "payload_bytes", lines.alias("headers"))


SQL = {
    "op7_warc_revisits": r"""
WITH base AS (
  SELECT page_id, url, sha256(coalesce(html, '')) AS sha, strlen(coalesce(html, '')) AS n, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
         1704067200 + page_id * 60 AS s FROM pages),
log AS (
  SELECT page_id * 8 AS record_id, url, s AS pos, true AS is_full, tag AS etag, 't' || s AS lm, sha, n, NULL AS vary FROM base
  UNION ALL SELECT page_id * 8 + 1, url, s + 604800, false, tag, NULL, NULL, NULL, NULL FROM base
  UNION ALL SELECT page_id * 8 + 2, regexp_replace(url, '#.*$', '') || '#again', s + 604801, false, 'W/' || tag, NULL, NULL, NULL, 'accept' FROM base WHERE page_id % 3 = 0
  UNION ALL SELECT page_id * 8 + 3, url, s - 3600, false, tag, NULL, NULL, NULL, NULL FROM base WHERE page_id % 5 = 0
  UNION ALL SELECT page_id * 8 + 4, url, s + 604802, false, '"other"', 't' || s, NULL, NULL, NULL FROM base WHERE page_id % 7 = 0
  UNION ALL SELECT page_id * 8 + 5, url, s + 604803, false, NULL, 't' || s, NULL, NULL, NULL FROM base WHERE page_id % 11 = 0
  UNION ALL SELECT page_id * 8 + 6, url, s + 604804, false, NULL, NULL, NULL, NULL, NULL FROM base WHERE page_id % 13 = 0),
bare AS (SELECT *, regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') AS b FROM log),
canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') ||
    CASE WHEN q = '' THEN regexp_replace(p, '/$', '') ELSE p || '?' || q END AS c
  FROM (SELECT *, regexp_extract(regexp_replace(b, '^[^/?]*', ''), '^[^?]*') AS p,
          regexp_replace(regexp_replace(regexp_extract(b, '\?(.*)$', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS q FROM bare)),
paired AS (
  SELECT v.*, r.record_id AS rid, r.etag AS retag, r.lm AS rlm, r.sha AS rsha, r.n AS rn, r.pos AS rat,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.pos DESC NULLS LAST, r.record_id DESC NULLS LAST) AS k
  FROM canon v LEFT JOIN canon r ON r.is_full AND r.c = v.c AND r.pos < v.pos WHERE NOT v.is_full),
judged AS (
  SELECT *, CASE WHEN etag IS NOT NULL AND retag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '')
                 ELSE lm = rlm END AS agrees FROM paired WHERE k = 1),
told AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN agrees THEN 'resolved' WHEN agrees IS NULL THEN 'unverified' ELSE 'mismatch' END AS status FROM judged)
SELECT record_id, url, c AS canonical_url, pos AS captured, status,
  CASE WHEN rid IS NULL THEN NULL WHEN etag IS NOT NULL AND retag IS NOT NULL THEN 'etag' WHEN lm IS NOT NULL AND rlm IS NOT NULL THEN 'last-modified' END AS via,
  CASE WHEN status = 'resolved' THEN rid END AS response_id, CASE WHEN status = 'resolved' THEN rsha END AS payload_sha256,
  CASE WHEN status = 'resolved' THEN rn END AS payload_bytes,
  CASE WHEN status = 'resolved' THEN concat_ws(chr(10), 'content-type: text/html', 'date: ' || pos, 'etag: ' || coalesce(etag, retag),
    'last-modified: ' || coalesce(lm, rlm), 'vary: ' || vary) END AS headers
FROM told"""
}

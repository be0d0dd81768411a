"""Periodic runs of words, found by Main-Lorentz divide and conquer.

A run is a stretch of consecutive words with smallest period q (words q apart are the same)
that is at least ``least`` words and ``times`` periods long and that no neighbouring word
extends with that period.

Words become interned ids. A block of words is cut at its midpoint. For every period p of a
crossing run, Z-functions tell how far words p apart agree to both sides of the midpoint: the
right half against itself and the left half reversed (a run with p words right of the
midpoint, or p words left of it, shows in one of them). That gives the run's ends for each p at
once. Ends at the block's own border where words outside agree too are dropped, since a
larger block has that run whole. Of one interval's periods the smallest stays. Halves shorter than
``least`` words can't hold a run.

Before that, a sieve that loses nothing leaves out plain text: in a run, every ``WINDOW``
words stand again a period away (2q + WINDOW > length >= max(least, times * q) has no solution for the
values allowed here), so a run lies in a stretch of places whose next WINDOW words repeat in the
document. Windows of a batch are compared by hash; a collision can only let more through.

A document is one row and is searched where it is read: nothing is shuffled. Time is
n log n in its words.

Behaviour: null text counts as empty and has no runs. Null doc_ids and repeated rows are rows
of their own. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import table, text_or_empty

LEAST, TIMES, WINDOW = 24, 3, 8
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("collapsed", T.StringType())]


def z_function(x: list[int], upto: int) -> list[int]:
    """z[i]: how many words from x[i] on equal those from x[0] on, for i < upto; z[0] is 0."""
    n = len(x)
    z = [0] * upto
    left = right = 0
    first = x[0] if n else 0
    for i in range(1, upto):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif x[i] != first:
            continue
        else:
            k = 1
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def crossing(x: list[int], lo: int, mid: int, hi: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the stretches in x[lo:hi] across mid whose words p apart agree, as long as runs are."""
    most = (hi - lo) // times
    left, right = x[lo:mid][::-1], x[mid:hi]
    ahead, behind = min(most, hi - mid - 1), min(most, mid - lo - 1)
    # the left half reversed, then the words from mid + ahead down: left half against itself, and against what lies p further
    back = z_function([*left, -1, *x[lo : mid + ahead][::-1]], mid - lo + 1 + ahead)
    forth = z_function([*right, -1, *x[mid - behind : hi]], hi - mid + 1 + behind)
    p = np.arange(1, ahead + 1)
    start1 = mid - np.array(back[mid - lo + 1 :], np.int64)[::-1]
    end1 = mid + p + np.array(forth[1 : ahead + 1], np.int64)
    q = np.arange(1, behind + 1)
    start2 = mid - q - np.array(back[1 : behind + 1], np.int64)
    end2 = mid + np.array(forth[hi - mid + 1 :], np.int64)[::-1]
    start, end, period = np.concatenate([start1, start2]), np.concatenate([end1, end2]), np.concatenate([p, q])
    long = end - start >= np.maximum(least, times * period)
    return start[long], end[long], period[long]


def find_runs(x: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ids x, by start, then period."""
    n = len(x)
    shortest: dict[tuple[int, int], int] = {}
    blocks = [(0, n)]
    while blocks:
        lo, hi = blocks.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        for s, e, p in zip(*(c.tolist() for c in crossing(x, lo, mid, hi, least, times))):
            if (s > 0 and x[s - 1] == x[s - 1 + p]) or (e < n and x[e] == x[e - p]):
                continue  # goes on outside of this block
            if p < shortest.get((s, e), n):
                shortest[s, e] = p
        blocks += [(lo, mid), (mid, hi)]
    return sorted((s, e - s, p) for (s, e), p in shortest.items())


def candidates(ids: np.ndarray, document: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of the words of many documents, each within one document, outside of which no run lies."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return []
    h = np.zeros(n, np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for k in range(WINDOW):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    h += document[:n].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    inside = document[:n] == document[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.argsort(h[at])]
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(n + 2, bool)
    again[1 + order[1:][same]] = again[1 + order[:-1][same]] = True
    # a stretch also ends where the document does: windows across documents are never marked
    edge = np.flatnonzero(again[1:] != again[:-1])
    return [(a, b + WINDOW - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a + WINDOW - 1 >= least]


def runs_of(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text's words."""
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    sizes = np.array([len(w) for w in texts], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    document = np.repeat(np.arange(len(texts)), sizes)
    out: list[list] = [[] for _ in texts]
    for a, b in candidates(ids, document, least):
        d = int(document[a])
        shift = a - int(begin[d])
        out[d] += [(s + shift, length, p) for s, length, p in find_runs(ids[a:b].tolist(), least, times)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words outside of runs, and those of each run's first period unless another run drops them."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        edges[s + p] += 1
        edges[s + length] -= 1
    return [w for w, dropped in zip(words, np.cumsum(edges[:-1]).tolist()) if not dropped]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed: the kept words joined by a space."""
    if times < 3 or least < 3 * WINDOW:
        raise ValueError(f"runs of fewer than 3 periods or {3 * WINDOW} words would pass the sieve unseen")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(*f) for f in FOUND)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                # bytes.split() parts at exactly space, tab, LF, VT, FF and CR
                words = [t.split() for t in part.column("text").cast(pa.binary()).to_pylist()]
                runs = runs_of(words, least, times)
                columns = [
                    part.column("doc_id").cast(arrow.field(0).type),
                    pa.array(map(len, words), pa.int64()),
                    pa.array([[dict(zip(RUN.names, r)) for r in x] for x in runs], arrow.field(2).type),
                    pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(task, schema)


def with_periods(docs: DataFrame) -> DataFrame:
    """docs with periodic ends written into the texts of about a tenth: by h = crc32 of doc_id, words from a on repeat the p words there. Null doc_ids are left as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", text_or_empty().alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("picked"))
    docs = docs.withColumn("words", F.when(F.col("picked"), words)).withColumn("n", F.size("words").cast("long"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    once = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.flatten(F.array_repeat(once, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    made = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), F.col("n") - F.col("a")))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def _longest() -> Column:
    """The run of greatest length / period, compared exactly; ties: least start, then period."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate("runs", F.lit(None).cast(RUN), better)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents"))).withColumn("best", _longest())
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in RUN.names),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

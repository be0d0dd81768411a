"""Language identification by sparse multinomial logistic regression on character n-grams.

Features: TF-IDF of hashed character 2- and 3-grams, log(1 + count) * idf, scaled to length
one. Letters are lower-cased, every run of other characters is one space. Document
frequencies count all rows that may be learned from. Weights are fitted by
follow-the-regularised-leader with elastic-net (L1 and L2) penalties on at most
``per_language`` labelled rows of each language, the first by a digest of the doc_id; a fifth of
those rows is kept out of the fit and sets the temperature that calibrates the
probabilities. Only that bounded sample's sparse features reach the driver, which needs about
0.6 MB for each language.

Behaviour: a text that is null or has no letter is ``und`` with score 0. Rows with null
doc_id or null lang are never learned from; null doc_ids are not held out. With no row to
learn from, every row is ``und``. Every language that rows are labelled with is learned. Rows
that repeat are answered each. Texts of any length are read whole, in
parts. Other columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable, table

BUCKETS = 1 << 15
#: Rows of a language that the classifier is fitted on, at most.
PER_LANGUAGE = 1500
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
#: Characters that are counted at once.
PART = 1 << 20

_TABLE: np.ndarray | None = None


def _folding() -> np.ndarray:
    """For every code point its lower-case letter, or 32 if it isn't a letter."""
    global _TABLE
    if _TABLE is None:
        points = np.full(0x110000, 32, np.uint32)
        for start in (0, 0x10000, 0x20000, 0x30000):  # planes with letters
            for c in range(start, start + 0x10000):
                x = chr(c)
                if x.isalpha():
                    low = x.lower()
                    points[c] = ord(low) if len(low) == 1 else c
        _TABLE = points
    return _TABLE


def ngram_counts(text: str, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, ascending, and their counts; empty if it has no letter. A blank stands before the text."""
    fold, total = _folding(), np.zeros(BUCKETS, np.int64)
    letters, last = False, np.array([32], np.uint32)
    for a in range(0, len(text), part):
        x = fold[np.frombuffer(text[a : a + part].encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint32)
        letters |= bool((x != 32).any())
        x = np.concatenate([last, x])
        x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]
        two = x[:-1] * np.uint32(0x9E3779B1) + x[1:]
        three = (two[:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
        for h in (two[len(last) - 1 :] * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)):  # what lies in last alone is counted
            total += np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(17), minlength=BUCKETS)
        last = x[-2:]
    if not letters:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = np.flatnonzero(total)
    return on, total[on]


def tfidf(on: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[on]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_regularised_leader(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, l1: float, l2: float, alpha: float, beta: float, epochs: int, seed: int
) -> np.ndarray:
    """Per-coordinate FTRL-proximal weights, buckets by classes; most are exactly zero under L1."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            on, x = rows[i]
            zi, ni = z[on], n[on]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            grown = ni + g * g
            z[on] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[on] = grown
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The T that minimises the log loss of softmax(scores / T), by golden-section search on log T."""

    def loss(log_t: float) -> float:
        p = _softmax(scores / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        on, counts = ngram_counts(text or "")
        if not len(on) or not self.labels:
            return UNKNOWN, 0.0
        p = _softmax(tfidf(on, counts, self.idf) @ self.weights[on].astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def held_out(folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def fit(
    docs: DataFrame, per_language: int = PER_LANGUAGE, l1: float = 0.05, l2: float = 0.05, alpha: float = 1.0, beta: float = 1.0, epochs: int = 3, seed: int = 7
) -> LanguageModel:
    """A model of docs' text and lang columns; rows held out, or without doc_id or lang, are not read."""
    learn = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sizes = learn.groupBy("lang").count().collect()  # a row a language
    labels = sorted(r["lang"] for r in sizes)
    if not labels:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS, 1), np.float32), 1.0)

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("df", T.LongType())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                df[ngram_counts(text.as_py() or "")[0]] += 1
            rows += batch.num_rows
        df[BUCKETS] = rows
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(df[on])], names=schema.names)

    counted = learn.select("text").mapInArrow(frequencies, schema).groupBy("bucket").agg(F.sum("df").alias("df"))
    df = np.zeros(BUCKETS + 1)
    for r in counted.collect():  # a row a bucket
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    spark = docs.sparkSession
    # drawn with room to spare, so that seldom fewer than per_language are left to rank
    shares = spark.createDataFrame([(r["lang"], min(1.0, 1.25 * per_language / r["count"] + 64 / r["count"])) for r in sizes], "of string, share double")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    sample = learn.join(F.broadcast(shares), F.col("lang") == F.col("of")).withColumn("draw", draw).filter("draw < share")
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("draw", T.DoubleType()), T.StructField("on", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t.as_py() or "") for t in batch.column("text")]
            arrays = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), *arrays], names=kind.names)

    drawn = durable(sample.select("text", "lang", "draw").mapInArrow(features, kind), "language-sample")
    first = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "on", "n"))).filter(F.col("rank") <= per_language)
    table_ = first.drop("rank").orderBy("draw", "lang", "on", "n").toArrow()
    on = [x.values.to_numpy() if x.values is not None else np.zeros(0, np.int32) for x in table_.column("on")]
    counts = [x.values.to_numpy() if x.values is not None else np.zeros(0, np.int32) for x in table_.column("n")]
    known = [k for k in range(len(on)) if len(on[k])]
    index = {lang: k for k, lang in enumerate(labels)}
    y = np.array([index[x.as_py()] for x in table_.column("lang")], dtype=np.int64)[known] if known else np.zeros(0, np.int64)
    rows = [(on[k], tfidf(on[k], counts[k], idf)) for k in known]
    kept_out = np.arange(len(rows)) % 5 == 4
    weights = follow_the_regularised_leader([r for r, k in zip(rows, kept_out) if not k], y[~kept_out], len(labels), l1, l2, alpha, beta, epochs, seed)
    scores = np.array([x @ weights[o] for (o, x), k in zip(rows, kept_out) if k]).reshape(-1, len(labels))
    t = temperature(scores, y[kept_out]) if len(scores) else 1.0
    return LanguageModel(labels, idf, weights.astype(np.float32), t)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score; one row for each row of docs."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column("text")]
            arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(task, schema)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs whose text has a language, with all their columns; others are rejected."""
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.predict(t.as_py())[0] != UNKNOWN for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(task, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

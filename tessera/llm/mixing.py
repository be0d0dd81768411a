"""Mixing sources to target weights by capped water-filling (DataFrame operations only).

Targets: every source gets min(cap, level * weight) words, where cap is ``max_epochs`` times
its size. The level is the one that spends all words: what capped sources cannot take is
reshared over the rest by weight until none is above its cap. Sources sorted by cap/weight
make that level a maximum over prefix sums, with no loop. Ranks and prefix sums are taken
within ranges of the order, to which the sums of earlier ranges are added, so no task holds
all sources.

Sampling: a document is taken floor(target / source size) times; the words that are then
still missing come from one more repetition of the documents that are first by a seeded
digest. The cut is found by narrowing digest buckets (two rounds of 1,024), so that no task
ever orders a whole source; it ends at a digest, up to which documents are taken once more.
The document at the cut is taken if that comes nearer to the target. The plan, one row a
source, is sent to the tasks up to ``MOST_SENT`` sources of names of ``MOST_NAMES`` bytes
together; beyond that rows and plan meet by (source, salt).

Behaviour: null or empty text has size 0 and is taken 0 words. Null source is a source of its
own, last in order. Null doc_ids are drawn by a digest of their text. Rows that repeat one
doc_id and size each count as a document, and are taken equally often. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, durable, table, text_or_empty

WEIGHTS, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 3, 7
#: Bits of the digest that each round of narrowing the cut uses.
BITS, ROUNDS = 10, 2
#: Sources and bytes of their names up to which the plan is broadcast, and the salts of a source beyond that.
MOST_SENT, MOST_NAMES, SALTS = 100_000, 8 << 20, 64


def _prefix_sums(rows: DataFrame, order: Sequence[Column], **sums: Column) -> DataFrame:
    """rows with, for each name, the sum of its column over the rows before this one in order, which is total."""
    dealt = durable(rows.withColumns(sums).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = totals.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    joined = dealt.join(F.broadcast(earlier), F.col("_range") == F.col("_of"))
    return joined.withColumns({c: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{c}") for c in sums}).drop("_range", "_of", *[f"_{c}" for c in sums])


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from rows (source, size)."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _prefix_sums(each, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    capped = ranked.select(
        "source",
        "source_size",
        F.element_at(cycle, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * max_epochs).cast("double").alias("cap"),
        "rank",
    )
    summed = durable(_prefix_sums(capped.withColumn("worth", F.col("cap") / F.col("weight")), [F.col("worth"), F.col("rank")], caps=F.col("cap"), lighter=F.col("weight")), "mix-sums")
    total = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("heft"))
    level = (F.col("words") - F.col("caps")) / (F.col("heft") - F.col("lighter"))
    top = summed.crossJoin(F.broadcast(total)).agg(F.max(level).alias("level"))  # of one row each
    return summed.crossJoin(F.broadcast(top)).select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _with_plan(rows: DataFrame, plan: DataFrame, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with the plan's row of their source, which is named ``of`` there."""
    n, size = plan.agg(F.count(F.lit(1)), F.sum(F.octet_length("of"))).first()
    same = F.col("source").eqNullSafe(F.col("of"))
    if n <= MOST_SENT and (size or 0) <= MOST_NAMES:
        return rows.join(F.broadcast(plan), same, how)
    salted = rows.withColumn("_salt", F.pmod(F.col("spot"), F.lit(salts)))
    dealt = plan.withColumn("_of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(dealt, same & (F.col("_salt") == F.col("_of_salt")), how).drop("_salt", "_of_salt")


def _sized(docs: DataFrame, seed: int, *columns: str) -> DataFrame:
    """doc_id, source, size, key, spot, and further columns of docs."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty()))
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    sized = docs.withColumn("_tessera_size", size).withColumn("_tessera_key", F.md5(F.concat_ws(":", F.lit(str(seed)), identity, F.col("_tessera_size").cast("string"))))
    spot = F.conv(F.substring("_tessera_key", 1, 8), 16, 10).cast("long")
    return sized.select("doc_id", "source", F.col("_tessera_size").alias("size"), F.col("_tessera_key").alias("key"), spot.alias("spot"), *columns)


def mix_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """of (a source), source_size, target, whole, cut, last_key: rows are taken whole times, and once more up to last_key."""
    targets = durable(
        source_targets(sized, weights, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    cuts = targets.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("cut"), F.col("missing").alias("left"))
    for k in range(1, ROUNDS + 1):  # the bucket in which a source's words run out, ten bits narrower each round
        held = _with_plan(sized, cuts).filter(F.shiftright("spot", 32 - BITS * (k - 1)) == F.col("cut"))
        sums = held.groupBy("source", F.shiftright("spot", 32 - BITS * k).alias("bucket"), "left").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        cuts = durable(
            sums.withColumn("upto", upto)
            .filter(F.col("upto") >= F.col("left"))
            .groupBy(F.col("source").alias("of"))
            .agg(F.min(F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("words"))).alias("rest"))).alias("c"))
            .select("of", F.col("c.bucket").alias("cut"), F.col("c.rest").alias("left")),
            "mix-cuts",
        )
    edge = _with_plan(sized, cuts).filter(F.shiftright("spot", 32 - BITS * ROUNDS) == F.col("cut"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = edge.withColumn("upto", upto).filter(F.col("upto") - F.col("size") / 2.0 <= F.col("left"))
    last = within.groupBy(F.col("source").alias("within")).agg(F.max("key").alias("last_key"))
    cut = cuts.join(last, F.col("of").eqNullSafe(F.col("within")), "left").select(F.col("of").alias("cut_of"), "cut", "last_key")
    named = targets.join(cut, F.col("source").eqNullSafe(F.col("cut_of")), "left")
    return durable(named.select(F.col("source").alias("of"), "source_size", "target", "whole", "cut", "last_key"), "mix-plan")


def _reps(max_epochs: int) -> Column:
    bucket = F.shiftright("spot", 32 - BITS * ROUNDS)
    extra = F.coalesce((bucket < F.col("cut")) | ((bucket == F.col("cut")) & (F.col("key") <= F.col("last_key"))), F.lit(False))
    return F.least(F.col("whole") + extra.cast("long"), F.lit(max_epochs))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, reps, taken; one row for each row of docs."""
    sized = durable(_sized(docs, seed), "mix-sizes")
    rows = _with_plan(sized, mix_plan(sized, weights, max_epochs)).withColumn("reps", _reps(max_epochs))
    return rows.select("doc_id", "source", "size", "source_size", "target", "reps", (F.col("reps") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay. Texts are read twice and not shuffled where the plan is sent."""
    plan = mix_plan(durable(_sized(docs, seed), "mix-sizes"), weights, max_epochs)
    whole = docs.withColumn("_tessera_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = _with_plan(_sized(whole, seed, "_tessera_row"), plan).withColumn("reps", _reps(max_epochs)).filter("reps > 0")
    return rows.select("_tessera_row", F.explode(F.sequence(F.lit(1), F.col("reps").cast("int"))).alias("_tessera_copy")).select("_tessera_row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op9_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS identity, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
each AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source),
capped AS (
  SELECT *, ([5.0, 2.0, 1.0])[(rank - 1) % 3 + 1]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM each),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
targets AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight)::DOUBLE AS target FROM levels),
ordered AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('7:' || s.identity || ':' || s.size::VARCHAR)
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(whole + CASE WHEN upto - size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM ordered"""
}

"""Keyed picks, paging and write semantics, as functions of DataFrames.

Every pick has a total order, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the first in order. Aggregates before the shuffle, so hot keys cost a row a task."""
    columns = [c for c in df.columns if c not in keys]
    ranks = [o if isinstance(o, Column) else F.col(o) for o in order]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*ranks)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in columns]).select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank. Spark keeps n rows a key and task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


#: Rows that a task gathers by key.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys over as many tasks as so many rows need, so that a task's memory doesn't grow with the table; no fewer than shuffles have."""
    return df.repartition(max(_shuffle_tasks(df), -(-rows // ROWS_A_TASK)), *keys)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df as it is where a shuffle's tasks are enough for so many rows, else dealt by keys, on which a join or an aggregate then works in as many tasks."""
    return dealt(df, rows, *keys) if rows > ROWS_A_TASK * _shuffle_tasks(df) else df


def _shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def chunk(df: DataFrame, keys: Sequence[str], size: int, *order: Column) -> DataFrame:
    """Number rows within a key and cut them into chunks of size."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def upsert_overwrite(base: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace base rows of the same key."""
    return incoming.unionByName(base.join(incoming, list(keys), "left_anti"))


def insert_ignore(base: DataFrame, incoming: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Base rows, and the first incoming row of each key that base lacks."""
    fresh = incoming.join(base, list(keys), "left_anti")
    return base.unionByName(pick_first(fresh, keys, *order))


def upsert_merge(base: DataFrame, incoming: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """Full outer merge with a rule a column: new, old, fill_new (new unless blank), fill_old, greatest."""
    b = base.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in rules])
    n = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rules], F.lit(True).alias("_has_new"))
    b = b.withColumn("_has_old", F.lit(True))

    def merged(c: str, rule: str) -> Column:
        old, new = F.col(f"_old_{c}"), F.col(f"_new_{c}")
        blank = lambda x: F.when(x.cast("string") == "", None).otherwise(x)
        both = {
            "new": F.when(F.col("_has_new"), new).otherwise(old),
            "old": F.when(F.col("_has_old"), old).otherwise(new),
            "fill_new": F.coalesce(blank(new), old),
            "fill_old": F.coalesce(blank(old), new),
            "greatest": F.greatest(old, new),
        }
        return both[rule].alias(c)

    return b.join(n, list(keys), "full").select(*keys, *[merged(c, r) for c, r in rules.items()])


def sync(rules: DataFrame, stored: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """What a three-way sync does to each key: add, update, keep or deactivate."""
    r = rules.select(F.col(key), F.struct(*compared).alias("_r"), F.lit(True).alias("_in_rules"))
    s = stored.select(F.col(key), F.struct(*compared).alias("_s"), F.lit(True).alias("_in_store"))
    action = (
        F.when(F.col("_in_store").isNull(), "add")
        .when(F.col("_in_rules").isNull(), "deactivate")
        .when(F.col("_r").eqNullSafe(F.col("_s")), "keep")
        .otherwise("update")
    )
    return r.join(s, key, "full").select(key, action.alias("action"))


def first_match(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, then: str, columns: Sequence[str], part: str = "month") -> DataFrame:
    """left, and the columns of the latest row of right with its keys that is not after it (then <= at); nulls where there is none.

    Of right rows at one time the greatest stands. A key's rows are ordered within parts of time (``month``, ``day``, ...) and not as
    a whole; what a part begins with is carried over from the parts before, a row each. So a hot key is many tasks' work.
    """
    last = lambda w: F.last("_r", ignorenulls=True).over(w)
    rows = right.select(*keys, F.struct(*columns).alias("_r"), F.col(then).cast("timestamp").alias("_t")).dropna(subset=[*keys, "_t"])
    rows = rows.withColumns({"_part": F.date_trunc(part, "_t"), "_left": F.lit(False)})
    asked = left.withColumns({"_t": F.col(at).cast("timestamp"), "_left": F.lit(True)}).withColumn("_part", F.date_trunc(part, "_t"))
    both = asked.unionByName(rows, allowMissingColumns=True)
    within = both.withColumn("_r", last(Window.partitionBy(*keys, "_part").orderBy("_t", "_left", "_r"))).filter("_left")
    parts = rows.groupBy(*keys, "_part").agg(F.max_by("_r", F.struct("_t", "_r")).alias("_r"))
    parts = parts.unionByName(asked.select(*keys, "_part").distinct(), allowMissingColumns=True).groupBy(*keys, "_part").agg(F.max("_r").alias("_r"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, "_part", last(before).alias("_before")).filter("_before IS NOT NULL")
    found = within.join(carried, [*keys, "_part"], "left").withColumn("_r", F.coalesce("_r", "_before"))
    return found.select(*left.columns, *[F.col("_r")[c].alias(c) for c in columns])

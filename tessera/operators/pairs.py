"""Pairs of members that share items, counted without a square of pairs for items that many share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.lineage import cut

#: Members of an item up to which its pairs are made as they are.
LIGHT = 1_000
#: Members and rows of a bucket of members, buckets up to which hubs are counted in cells where looking them up spares little, pairs made at once.
BUCKET, BUCKET_ROWS, MOST_BUCKETS, AT_ONCE = 50_000, 2_000_000, 64, 2_000_000
#: Buckets that rows of this many or more are dealt to, for tasks; pairs of heavy items up to which they are counted in cells in any case.
LEAST_BUCKETS, TASK_ROWS, FEW_PAIRS = 8, 20_000, 10**10
#: Pairs that may move, a row. Rows from which first pairs are sought among the members with most items before all, such members and their rows.
MOVED_A_ROW, PROBE_FROM, PROBED, PROBED_ROWS = 4, 500_000, 4_096, 400_000


def _dealt_wedges(rows: DataFrame, light: int) -> DataFrame:
    """Pairs of heavy items (no, m, degree), in cells of two chunks of an item's members.

    Chunks go by a hash of the member, so that one cell of items of like degree has the same members:
    its pairs are summed where they are made, before they move.
    """
    bits = F.length(F.bin(F.floor((F.col("degree") - 1) / light)))
    dealt = rows.select("no", "m", F.call_function("shiftleft", F.lit(1), bits).alias("k"))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("m"), F.col("k")).cast("int"))
    left = dealt.select("no", "k", F.col("c").alias("lo"), F.explode(F.sequence(F.col("c"), F.col("k") - 1)).alias("hi"), F.col("m").alias("x"))
    right = dealt.select("no", "k", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("lo"), F.col("c").alias("hi"), F.col("m").alias("y"))
    left, right = left.repartition("k", "lo", "hi"), right.repartition("k", "lo", "hi")
    met = left.join(right, ["k", "lo", "hi", "no"]).filter("lo < hi OR x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _counts_at_once(first: np.ndarray, other: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left member, right member, pairs) of rows by left member, each met by the right rows begin to end; about AT_ONCE pairs are made at once, or one member's."""
    upto = np.concatenate([[0], np.cumsum(end - begin)])
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [len(first)]])  # of members
    k = 0
    while k < len(bounds) - 1:
        e = max(int(np.searchsorted(upto[bounds], upto[bounds[k]] + AT_ONCE, "right")) - 1, k + 1)
        rows = slice(bounds[k], bounds[e])
        wide = (end - begin)[rows]
        left = first[rows] - first[bounds[k]]
        size = (int(left[-1]) + 1) * width
        kind = np.int64 if size >= 2**31 else np.int32
        at = np.arange(int(wide.sum())) + np.repeat(begin[rows] - (np.cumsum(wide) - wide), wide)
        places = np.repeat((left * width).astype(kind), wide) + other[at].astype(kind)
        if size <= 8 * len(places):
            n = np.bincount(places, minlength=size)
            place = np.flatnonzero(n)
            n = n[place]
        else:
            places.sort()
            edge = np.flatnonzero(np.diff(places, prepend=places[:1] - 1))
            place, n = places[edge].astype(np.int64), np.diff(edge, append=len(places))
        yield place // width + first[bounds[k]], place % width, n
        k = e


def _packed(rows: pa.Table) -> dict[str, np.ndarray | pa.Array]:
    """A bucket's rows (no, m, maybe spare), by member and by item: names of members, ascending, items of each (per, item), members of each item (items, sizes, ms)."""
    values = rows.column("m").combine_chunks()
    names, at, m = np.unique(values.to_numpy(zero_copy_only=False) if pa.types.is_primitive(values.type) else np.array(values.to_pylist(), dtype=object), return_index=True, return_inverse=True)
    items, no = np.unique(rows.column("no").to_numpy(), return_inverse=True)
    spare = rows.column("spare").to_numpy()[at] if "spare" in rows.column_names else np.zeros(0, np.int64)
    small = {"per": np.bincount(m, minlength=len(names)), "item": no[np.lexsort((no, m))], "sizes": np.bincount(no, minlength=len(items)), "ms": m[np.lexsort((m, no))]}
    return {"names": pa.array(names.tolist(), values.type), "items": items, "spare": spare} | {k: v.astype(np.int32) for k, v in small.items()}


def _counted(left: dict, right: dict, same: bool, least: int, first: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(member of left, member of right, shared) of two buckets, or of one with itself (same), from so many shared items on; no more than about AT_ONCE pairs are held at once.

    first: only so many, the most shared first, then by members.
    """
    ends = np.cumsum(right["sizes"], dtype=np.int64)
    members = np.repeat(np.arange(len(left["per"])), left["per"])
    if same:  # a row meets those of its item behind it
        begin, end = np.argsort(right["ms"], kind="stable") + 1, ends[left["item"]]
    else:
        place = np.minimum(np.searchsorted(right["items"], left["items"]), len(right["items"]) - 1)
        there = right["items"][place] == left["items"]
        begin, end = (np.where(there, x, 0)[left["item"]] for x in ((ends - right["sizes"])[place], ends[place]))
    met = np.flatnonzero(end > begin)
    best = [np.zeros(0, np.int64)] * 3
    for a, b, n in _counts_at_once(members[met], right["ms"], begin[met], end[met], len(right["names"])) if len(met) else ():
        keep = n >= least if not len(left["spare"]) else n + np.minimum(left["spare"][a], right["spare"][b]) >= least
        a, b, n = a[keep], b[keep], n[keep]
        if first is None:
            yield a, b, n
        elif len(n):
            a, b, n = map(np.concatenate, zip(best, (a, b, n)))
            order = np.lexsort((b, a, -n))[:first]
            best = [a[order], b[order], n[order]]
            if len(order) == first:  # fewer shared than the last of so many: not among the first
                least = max(least, int(best[2][-1]))
    if first is not None:
        yield tuple(best)


def _counted_in_cells(rows: DataFrame, least: int, buckets: int, first: int | None = None) -> DataFrame:
    """(a, b, shared) of rows (no, m) and, if there, spare: each cell of two buckets of members counts all its pairs in place, so no pair moves.

    Buckets are ranges of members. Each is written once, packed, and cells read their two: nothing is copied to each cell, so that what is
    written is in proportion to the rows, however widely an item's members are spread.
    spare of a member: items that are counted elsewhere; a pair short of least by no more than the lesser spare is kept.
    first: each task keeps so many of its pairs, the most shared first, then by a and b.
    """
    kind = rows.schema["m"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("shared", T.LongType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def count(left: dict, right: dict, same: bool, least: int = least) -> Iterator[pa.RecordBatch]:
        # Numbers of members ascend as members do, and so do buckets: a < b.
        for a, b, n in _counted(left, right, same, least, first):
            yield pa.RecordBatch.from_arrays([left["names"].take(pa.array(a)).cast(arrow.field(0).type), right["names"].take(pa.array(b)).cast(arrow.field(1).type), pa.array(n, pa.int64())], schema=arrow)

    if buckets == 1:

        def alone(table: pa.Table) -> pa.Table:
            bucket = _packed(table)
            return pa.Table.from_batches(count(bucket, bucket, True), arrow)

        return rows.withColumn("own", F.lit(0)).groupBy("own").applyInArrow(alone, schema)

    whole = {"per": np.int32, "item": np.int32, "items": np.int64, "sizes": np.int32, "ms": np.int32, "spare": np.int64}
    columns = [pa.field("own", pa.int32()), pa.field("names", pa.list_(arrow.field(0).type)), *(pa.field(k, pa.binary()) for k in whole)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            bucket = _packed(pa.Table.from_batches(held))
            values = [[held[0].column("own")[0].as_py()], [bucket["names"].to_pylist()], *([bucket[k].astype(of).tobytes()] for k, of in whole.items())]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, columns)], schema=pa.schema(columns))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, floor = arrow.empty_table(), least  # a task's first pairs of all its cells
        for batch in batches:
            for i in range(batch.num_rows):
                of = lambda side: {"names": batch.column(f"names_{side}")[i].values} | {k: np.frombuffer(batch.column(f"{k}_{side}")[i].as_buffer(), t) for k, t in whole.items() if f"{k}_{side}" in batch.schema.names}  # noqa: E731, B023
                counts = count(of("lo"), of("hi"), batch.column("own_lo")[i].as_py() == batch.column("own_hi")[i].as_py(), floor)
                if first is None:
                    yield from counts
                else:
                    best = pa.concat_tables([best, pa.Table.from_batches(counts, arrow)]).sort_by([("shared", "descending"), ("a", "ascending"), ("b", "ascending")]).slice(0, first)
                    if len(best) == first:
                        floor = max(floor, best.column("shared")[first - 1].as_py())
        yield from best.to_batches()

    ranged = rows.repartitionByRange(buckets, "m").withColumn("own", F.spark_partition_id())
    binary = ", ".join(f"{k} binary" for k in whole)
    packed = cut(ranged.mapInArrow(pack, f"own int, names array<{kind.simpleString()}>, {binary}"))
    side = lambda x, names: packed.select(*[F.col(c).alias(f"{c}_{x}") for c in ["own", "names", *names]])
    low, high = side("lo", ["per", "item", "items", "spare"]), side("hi", ["items", "sizes", "ms", "spare"])
    return low.hint("shuffle_replicate_nl").join(high, F.expr("own_lo <= own_hi")).mapInArrow(cells, schema)


def shared_pairs(
    named: DataFrame, member: str, items: Sequence[str], least: int = 3, light: int = LIGHT, bucket: int = BUCKET, most_buckets: int = MOST_BUCKETS, first: int | None = None
) -> DataFrame:
    """(a, b, shared): members a < b that share at least ``least`` different items, and how many. Exact. first: only so many, the most shared first, then by a and b, in that order.

    Pairs are counted in cells of two buckets of members, in place: no pair moves.
    Take each member's items by how many share them, the most shared last. Two members with ``least`` items in
    common have one in common that is not among the last ``least`` - 1 of either. So where that spares most pairs of heavy
    items, and few pairs are left, a heavy item makes no pairs for those members of which it is one of the last; whether they share it too is looked up
    for the pairs that the other items make, and what is left of heavy items is dealt out in cells of its own. These pairs move: no more than MOVED_A_ROW
    a row, so what is written stays in proportion to the rows either way. Both ways give the same. Rows with a null member or item name nothing.
    With ``first``, a member with fewer items than the last of the first pairs of any members shares is in none of them, and goes.
    """
    found = _all_shared_pairs(named, member, items, least, light, bucket, most_buckets, first)
    return found if first is None else found.orderBy(F.desc("shared"), "a", "b").limit(first)


def _shared_by_last(rows: DataFrame, least: int, first: int) -> int:
    """How many items the last of the first pairs shares at the least: as many as the last of the first pairs among the members with most items."""
    most = rows.groupBy("m").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "m").limit(PROBED)
    upto = F.sum("n").over(Window.orderBy(F.desc("n"), "m").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over PROBED rows
    most = cut(most.withColumn("upto", upto).filter(F.col("upto") <= PROBED_ROWS).select("m"))
    some = rows.join(most, "m", "left_semi").select("no", "m")
    found = _counted_in_cells(cut(some), least, LEAST_BUCKETS, first).orderBy(F.desc("shared"), "a", "b").limit(first).collect()
    return found[-1]["shared"] if len(found) == first else least


def _all_shared_pairs(named: DataFrame, member: str, items: Sequence[str], least: int, light: int, bucket: int, most_buckets: int, first: int | None) -> DataFrame:
    known = cut(named.select(F.col(member).alias("m"), *items).dropna().distinct())
    degrees = known.groupBy(*items).agg(F.count("*").alias("degree")).filter("degree > 1")
    degrees = cut(degrees.withColumn("no", F.monotonically_increasing_id()))
    rows = cut(known.join(degrees, list(items)).select("no", "m", "degree"))
    total = rows.count()
    if first is not None and total >= PROBE_FROM:
        floor = _shared_by_last(rows, least, first)
        if floor > least:
            least = floor
            own = rows.groupBy("m").count().filter(F.col("count") >= least).select("m")
            rows = rows.select("no", "m").join(own, "m", "left_semi")
            degrees = cut(rows.groupBy("no").agg(F.count("*").alias("degree")).filter("degree > 1"))
            rows = cut(rows.join(degrees, "no").select("no", "m", "degree"))
            total = rows.count()
    of_members = -(-rows.select("m").distinct().count() // bucket)
    buckets = max(1, of_members, -(-total // BUCKET_ROWS), min(LEAST_BUCKETS, total // TASK_ROWS))
    heavy = rows.filter(F.col("degree") > light)
    pairs_of = lambda df, size: df.agg(F.sum(F.col(size).cast("double") * (F.col(size) - 1) / 2)).first()[0] or 0.0
    square = pairs_of(degrees.filter(F.col("degree") > light), "degree")
    moved = pairs_of(degrees.filter(F.col("degree") <= light), "degree")
    most = MOVED_A_ROW * total
    if not square or moved > most or (of_members <= most_buckets and square <= FEW_PAIRS):
        return _counted_in_cells(rows.select("no", "m"), least, buckets, first)

    by = Window.partitionBy("m").orderBy(F.desc("degree"), F.desc("no"))
    last = cut(heavy.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= least - 1).select("no", "m"))
    rest = heavy.join(last, ["no", "m"], "left_anti")
    left = pairs_of(rest.groupBy("no").count(), "count")
    if moved + left > most or (of_members <= most_buckets and 4 * left > square):
        return _counted_in_cells(rows.select("no", "m"), least, buckets, first)

    spare = heavy.groupBy("m").agg(F.count("*").alias("spare"))
    few = rows.filter(F.col("degree") <= light).select("no", "m").join(spare, "m", "left").select("no", "m", F.coalesce("spare", F.lit(0)).alias("spare"))
    counts = _counted_in_cells(few, least, buckets).withColumnRenamed("shared", "n")
    counts = counts.unionAll(_dealt_wedges(rest, light).groupBy("a", "b").agg(F.count("*").alias("n"))).groupBy("a", "b").agg(F.sum("n").alias("n"))

    own = last.groupBy("m").agg(F.collect_list("no").alias("last"))  # least - 1 at most
    side = lambda x: own.select(F.col("m").alias(x), F.col("last").alias(f"last_{x}"))
    none = F.array().cast("array<bigint>")
    pairs = counts.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({f"last_{x}": F.coalesce(f"last_{x}", none) for x in "ab"})
    pairs = pairs.filter(F.col("n") + F.size("last_a") + F.size("last_b") >= least)
    pairs = cut(pairs.withColumn("n", F.col("n") + F.size(F.array_intersect("last_a", "last_b"))))
    asked = lambda x, y: pairs.select("a", "b", F.col(y).alias("m"), F.explode(F.array_except(f"last_{x}", f"last_{y}")).alias("no"))
    also = asked("a", "b").unionAll(asked("b", "a")).join(heavy.select("no", "m"), ["no", "m"], "left_semi")
    every = pairs.select("a", "b", "n").unionAll(also.select("a", "b", F.lit(1).cast("long")))
    return every.groupBy("a", "b").agg(F.sum("n").alias("shared")).filter(F.col("shared") >= least)

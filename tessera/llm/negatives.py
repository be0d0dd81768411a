"""Hard-negative mining by distributed radix selection over integer scores.

A row's score for an anchor is the inner product of their components, each scaled and
floored to an integer. Positives of an anchor are its best other rows of the same label. Each
(anchor, positive) has a window of scores, given as percentages of the positive's, and takes the
best rows of other labels in it. Both are one selection, of the first k rows by (score
descending, vec_id ascending) in a window, for many windows at once:

1. All rows are dealt into blocks and anchors into groups, by a hash of row numbers, so that a cell
   (block, group) has a bounded number of either. A cell scores its rows for its anchors.
2. For each window a cell counts its rows by the next digit of the score. The counts are sums
   over cells; a cell leaves out the digits behind the one where it has k rows by itself, since the kth row
   can't lie there. The digit of the kth row becomes the window's interval, and its next digits are
   counted. A score that more rows share than are wanted is refined by digits of vec_id in the same way.
3. When no interval has rows beyond the kth, cells hand over the rows within bounds, k for
   a window at most, and the first k of them are the answer.

So what moves between tasks is anchors, rows and counts; scores stay in the cells that made them.

Behaviour: rows with a null label, a null vector or any null or non-finite component take no part.
A null vec_id is no anchor and ranks behind all others among equal scores. Vectors of different
lengths are filled up with zeros; an empty vector scores 0. Repeated rows and repeated vec_ids are
rows of their own, as anchors, positives and negatives. A negative positive_score gives an
empty window. An empty table, or one without anchors, gives an empty result. Scaled components
beyond 32 bits, scores beyond 62 bits and vec_ids 2^62 or more apart are errors. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, durable, table

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows of a block, anchors of a group, anchors scored at once; bits of a digit of scores and of ids.
BLOCK_ROWS, GROUP_ANCHORS, AT_ONCE, SCORE_BITS, ID_BITS = 8_192, 8_192, 128, 10, 16

SPAN = "struct<slot:int,low:bigint,high:bigint,a:bigint,b:bigint,need:bigint,by_id:boolean,shift:int,cut:bigint,id_cut:bigint>"
COUNTS = T.StructType([T.StructField("anchor_row", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("digit", T.LongType()), T.StructField("n", T.LongType())])
PICKED = T.StructType([T.StructField("anchor_row", T.LongType()), T.StructField("slot", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("id_rank", "score"))])


def numbered(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows that take part: row (a number of its own), vec_id, id_rank (vec_id, null last), label, q (scaled components), norm. A written table."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("q"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v)))
    return durable(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


def _bits(width: Column) -> Column:
    """How many bits the numbers from 0 to width - 1 have."""
    return F.length(F.bin(width - 1))


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, handle, schema: T.StructType) -> DataFrame:
    """handle(rows, anchors) of every cell, as Arrow tables."""
    blocks, groups = -(-n_rows // BLOCK_ROWS) or 1, -(-n_anchors // GROUP_ANCHORS) or 1
    number = lambda n, row, seed: F.pmod(F.xxhash64(F.col(row), F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = max(blocks * groups, 1)
    left = rows.select("row", "id_rank", "label", "q", number(blocks, "row", 1).alias("block")).select("*", every(groups).alias("group"))
    right = anchors.select("*", number(groups, "anchor_row", 2).alias("group")).select("*", every(blocks).alias("block"))
    left, right = (d.repartition(tasks, "block", "group").groupBy("block", "group") for d in (left, right))

    def cell(some_rows: pa.Table, some_anchors: pa.Table) -> pa.Table:
        out = [pa.Table.from_pydict({n: [] for n in schema.names}, schema=_arrow(schema))]
        if some_rows.num_rows and some_anchors.num_rows:
            out += handle(some_rows, some_anchors)
        return pa.concat_tables(out)

    return left.cogroup(right).applyInArrow(cell, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, pa.int32() if f.dataType == T.IntegerType() else pa.int64()) for f in schema])


def _matrix(lists: pa.ListArray, width: int, kind: type) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scored(rows: pa.Table, anchors: pa.Table, kind: type, same: bool) -> Iterator[tuple]:
    """For each anchor: its number, its windows, and the scores and id ranks of its rows: others of its label if same, else those of other labels."""
    rows_q, anchors_q = rows.column("q").combine_chunks(), anchors.column("anchor_q").combine_chunks()
    width = max(max(q.value_lengths().to_numpy(zero_copy_only=False).max() for q in (rows_q, anchors_q)), 1)
    row, id_rank, label = (rows.column(c).to_numpy() for c in ("row", "id_rank", "label"))
    x, y = _matrix(rows_q, width, kind), _matrix(anchors_q, width, kind)
    own, own_label, spans = anchors.column("anchor_row").to_numpy(), anchors.column("anchor_label").to_numpy(), anchors.column("spans")
    for k in range(0, len(own), AT_ONCE):
        scores = (y[k : k + AT_ONCE] @ x.T).astype(np.int64)
        for i, s in enumerate(scores, k):
            fits = np.flatnonzero((label == own_label[i]) & (row != own[i]) if same else label != own_label[i])
            yield int(own[i]), spans[i].as_py(), s[fits], id_rank[fits]


def _count(kind: type, same: bool):
    def handle(rows: pa.Table, anchors: pa.Table) -> list[pa.Table]:
        found: list[list] = [[], [], [], []]
        for anchor, spans, score, id_rank in _scored(rows, anchors, kind, same):
            for w in spans:
                if w["by_id"]:
                    value = id_rank[score == w["cut"]]
                    value = (value[(value >= w["a"]) & (value <= w["b"])] - w["a"]) >> w["shift"]
                else:
                    value = (w["b"] - score[(score >= w["a"]) & (score <= w["b"])]) >> w["shift"]
                digit, n = np.unique(value, return_counts=True)
                upto = int(np.searchsorted(np.cumsum(n), w["need"])) + 1
                for column, values in zip(found, ([anchor] * min(upto, len(n)), [w["slot"]] * min(upto, len(n)), digit[:upto].tolist(), n[:upto].tolist())):
                    column += values
        return [pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, _arrow(COUNTS))], schema=_arrow(COUNTS))]

    return handle


def _gather(kind: type, same: bool, most: int):
    def handle(rows: pa.Table, anchors: pa.Table) -> list[pa.Table]:
        found: list[list] = [[], [], [], []]
        for anchor, spans, score, id_rank in _scored(rows, anchors, kind, same):
            for w in spans:
                within = (score <= w["high"]) & ((score > w["cut"]) | (score == w["cut"]) & (id_rank <= w["id_cut"]))
                at = np.flatnonzero(within)
                at = at[np.lexsort((id_rank[at], -score[at]))][:most]
                for column, values in zip(found, ([anchor] * len(at), [w["slot"]] * len(at), id_rank[at].tolist(), score[at].tolist())):
                    column += values
        return [pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, _arrow(PICKED))], schema=_arrow(PICKED))]

    return handle


def select(rows: DataFrame, anchors: DataFrame, windows: DataFrame, most: int, same: bool, facts: dict) -> DataFrame:
    """The first `most` rows of every window (anchor_row, slot, low, high: scores from and to): anchor_row, slot, rank, id_rank, score. A written table."""
    ids = facts["last_id"]
    shift = lambda bits: F.greatest(_bits(F.col("b") - F.col("a") + 1) - bits, F.lit(0)).cast("int")
    state = windows.select("anchor_row", "slot", "low", "high", F.col("low").alias("a"), F.col("high").alias("b"), F.lit(most).cast("long").alias("need"), F.lit(False).alias("by_id"))
    state = state.withColumns({"shift": shift(SCORE_BITS), "cut": F.col("low"), "id_cut": F.lit(ids), "done": F.lit(False)})
    state = durable(state, "negatives-windows")
    names = state.columns

    def with_spans(chosen: DataFrame) -> DataFrame:
        spans = chosen.groupBy("anchor_row").agg(F.collect_list(F.struct(*(F.col(c) for c in names[1:-1])).cast(SPAN)).alias("spans"))
        return anchors.join(spans, F.col("row") == F.col("anchor_row")).select(*(F.col(c).alias(f"anchor_{c}") for c in ("row", "label", "q")), "spans")

    while state.filter(~F.col("done")).limit(1).count():
        counts = _cells(rows, with_spans(state.filter(~F.col("done"))), facts["rows"], facts["anchors"], _count(facts["kind"], same), COUNTS)
        counts = counts.groupBy("anchor_row", "slot", "digit").agg(F.sum("n").alias("n"))
        by = Window.partitionBy("anchor_row", "slot").orderBy("digit")
        upto = counts.join(state.select("anchor_row", "slot", "need"), ["anchor_row", "slot"]).withColumn("upto", F.sum("n").over(by))
        kth = upto.groupBy("anchor_row", "slot").agg(F.min(F.when(F.col("upto") >= F.col("need"), F.struct("digit", "upto", "n"))).alias("kth"))
        after = durable(state.join(kth, ["anchor_row", "slot"], "left").select(*_narrowed(facts)).withColumn("shift", F.when(F.col("by_id"), shift(ID_BITS)).otherwise(shift(SCORE_BITS))).select(*names), "negatives-windows")
        discard(state)
        state = after
    picked = _cells(rows, with_spans(state), facts["rows"], facts["anchors"], _gather(facts["kind"], same, most), PICKED)
    best = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id_rank")
    picked = durable(picked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most), "negatives-picked")
    discard(state)
    return picked


def _narrowed(facts: dict) -> list[Column]:
    """A window's next state by the digit of its kth row. Finished: fewer rows than wanted are in the interval, or none beyond the kth."""
    digit, upto, n = (F.col(f"kth.{c}") for c in ("digit", "upto", "n"))
    open_, by_id = ~F.col("done"), F.col("by_id")
    step = F.call_function("shiftleft", digit, F.col("shift"))
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift"))
    few = digit.isNull()
    top = F.when(by_id, F.least(F.col("b"), F.col("a") + step + wide - 1)).otherwise(F.col("b") - step)
    bottom = F.when(by_id, F.col("a") + step).otherwise(F.greatest(F.col("a"), F.col("b") - step - wide + 1))
    exact, single = ~few & (upto == F.col("need")), ~few & (top == bottom)
    to_ids = open_ & ~few & ~exact & single & ~by_id  # one score that more rows have than are wanted
    ends = open_ & (few | exact | (single & by_id))
    cut = F.when(open_ & ~by_id, F.when(few, F.col("a")).otherwise(bottom)).otherwise(F.col("cut"))
    id_cut = F.when(open_ & by_id, F.when(few, F.col("b")).otherwise(top)).otherwise(F.col("id_cut"))
    moves = open_ & ~few
    return [
        "anchor_row", "slot", "low", "high",
        F.when(to_ids, F.lit(facts["first_id"])).when(moves, bottom).otherwise(F.col("a")).alias("a"),
        F.when(to_ids, F.lit(facts["last_id"])).when(moves, top).otherwise(F.col("b")).alias("b"),
        F.when(moves, F.col("need") - (upto - n)).otherwise(F.col("need")).alias("need"),
        (by_id | to_ids).alias("by_id"), "shift", cut.alias("cut"), id_cut.alias("id_cut"), (F.col("done") | ends).alias("done"),
    ]


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).

    is_anchor is a condition on vec_id. Negatives score from low to high per cent of the positive's score.
    """
    rows = numbered(vectors, scale)
    seen = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max("norm"), F.min("vec_id"), F.max("vec_id")).first()
    n_rows, n_anchors, norm, first_id, last_id = seen
    norm, first_id, last_id = norm or 0.0, first_id or 0, last_id or 0
    bound = int(norm * norm * 1.001) + 1
    if bound >= 1 << 62 or last_id - first_id >= 1 << 62:
        raise ValueError("scores of 62 bits and more, or vec_ids so far apart, can't be selected")
    # floats hold all sums of products exactly below 2^24 and 2^53; integers do beyond
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    facts = {"rows": n_rows, "anchors": n_anchors, "kind": kind, "first_id": first_id, "last_id": last_id + 1}
    rows = rows.withColumn("id_rank", F.coalesce("vec_id", F.lit(last_id + 1).cast("long")))
    anchors = rows.filter(is_anchor)

    everything = anchors.select(F.col("row").alias("anchor_row"), F.lit(0).alias("slot"), F.lit(-bound).cast("long").alias("low"), F.lit(bound).cast("long").alias("high"))
    near = select(rows, anchors, everything, positives, True, facts)
    near = near.select("anchor_row", F.col("rank").alias("slot"), F.col("id_rank").alias("positive_rank"), F.col("score").alias("positive_score"))
    p = F.col("positive_score").cast("decimal(38,0)")
    windows = near.withColumns({"low": F.ceil(p * low / 100).cast("long"), "high": F.floor(p * high / 100).cast("long")}).filter(F.col("low") <= F.col("high"))
    hard = select(rows, anchors, windows, negatives, False, facts)
    shown = lambda c: F.when(F.col(c) <= last_id, F.col(c))
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    found = hard.join(near, ["anchor_row", "slot"]).join(named, "anchor_row")
    return found.select(
        "anchor_id", shown("positive_rank").alias("positive_id"), F.col("rank").cast("int"), shown("id_rank").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


SQL = {
    "op12_hard_negatives": """
        WITH sound AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
                   list_dot_product(a.q, r.q)::BIGINT AS score
            FROM sound a JOIN sound r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
        near AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        ranked AS (
            SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
            FROM near JOIN scored USING (anchor_id)
            WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 3
    """,
}

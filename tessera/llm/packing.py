"""Best-fit packing by the sum-of-squares rule.

Every document becomes token ids plus an end token. A document longer than ``capacity`` is
cut into pieces of ``capacity`` tokens, of which the first may be shorter, so that it leaves
one short piece at most. Full pieces are sequences of their own. A short piece of length s
goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of open
sequences with g tokens left. A new sequence is opened only when no open one has room: that, with the
longest pieces first, needs far fewer sequences than weighing a new one too.

Tasks pack what they read, longest first, and keep piece lengths, never ids. The sequences
that they leave unfilled are few; a second round packs those, as items of their fill, over
tasks of bounded size. So texts are never shuffled.

Tokenisation: the vocabulary file of the tokenizers library is read into tiktoken, which
gives the same ids several times faster; a text that tiktoken cannot take is encoded by
tokenizers itself. Strings of special tokens in a text get their special id, as
``encode(text, add_special_tokens=False)`` does.

Behaviour: null text counts as empty and is one piece, the end token. Null doc_ids and rows
that repeat one doc_id are packed as rows of their own. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import durable, table, text_or_empty

CAPACITY, END_ID = 1024, 2
NO_ROOM = np.iinfo(np.int64).max
#: Unfilled sequences that a task of the second round packs.
ROUND_TWO = 50_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Text to ids as numpy arrays, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in word): n for word, n in spec["model"]["vocab"].items() if word not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        self._fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def slow(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        try:
            ids = self._fast.encode(text, allowed_special="all")
        except BaseException as e:  # tiktoken's panics on odd texts aren't Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            ids = self.slow(text)
        return np.asarray(ids, dtype="<u4")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length % capacity or capacity
    return [(0, min(first, length))] + [(s, capacity) for s in range(first, length, capacity)]


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of every item, and the number of sequences; items are placed longest first."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, made = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        cost = np.where(count[s:] > 0, 2 * (count[: capacity + 1 - s] - count[s:]) + 2, NO_ROOM)
        if count[s]:
            cost[0] = -2 * count[s] + 1  # this fills a sequence
        best = int(cost.argmin())
        gap = best + s
        if cost[best] == NO_ROOM:
            gap = capacity
            where[i], made = made, made + 1
        else:
            where[i] = open_at[gap].pop()
            count[gap] -= 1
        offset[i] = capacity - gap
        if gap > s:
            open_at[gap - s].append(int(where[i]))
            count[gap - s] += 1
    return where, offset, made


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row for each piece."""
    path = vocabulary or vocabulary_path()
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]
    )
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), ("piece", pa.int32())] + [(c, pa.int64()) for c in schema.names[2:]])

    def rows(doc_ids, numbers, where, offset) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(doc_ids), 50_000):
            b = a + 50_000
            columns = [*(numbers[a:b, k] for k in range(4)), where[a:b], offset[a:b]]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], arrow.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = Encoder(path), TaskContext.get().partitionId() << 36
        short_ids: list = []
        short: list[tuple] = []
        made = 0
        for batch in batches:
            full_ids, full = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    row = (piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    (full_ids if length == capacity else short_ids).append(doc_id)
                    (full if length == capacity else short).append(row)
            yield from rows(full_ids, np.array(full, dtype=np.int64).reshape(-1, 4), base + made + np.arange(len(full)), np.zeros(len(full), np.int64))
            made += len(full)
        numbers = np.array(short, dtype=np.int64).reshape(-1, 4)
        where, offset, _ = sum_of_squares(numbers[:, 2], capacity)
        yield from rows(short_ids, numbers, base + made + where, offset)

    pieces = durable(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(task, schema), "pack-pieces")

    unfilled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("fill")).filter(F.col("fill") < capacity)
    unfilled = durable(unfilled, "pack-unfilled")
    tasks = -(-unfilled.count() // ROUND_TWO) or 1
    moves = T.StructType([T.StructField(c, T.LongType()) for c in ("sequence_id", "to", "shift")])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fills = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            ids.append(batch.column("sequence_id").to_numpy())
            fills.append(batch.column("fill").to_numpy())
        own, fill = np.concatenate(ids), np.concatenate(fills)
        where, shift, made = sum_of_squares(fill, capacity)
        name = np.zeros(made, np.int64)
        name[where] = own  # a joint sequence goes by the id of one of its parts
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(name[where]), pa.array(shift)], names=moves.names)

    moved = durable(unfilled.repartition(tasks).mapInArrow(again, moves), "pack-moves")
    return pieces.join(moved, "sequence_id", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("to", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

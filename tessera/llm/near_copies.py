"""Near copies: documents whose SimHash fingerprints differ in two bits or fewer, or whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The fingerprints and their links are op8's, by its operator (simhash): vantage-point shards over all texts. Two bits miss most
pairs of that similarity, so an exact join by words finds these as well:

1. Signatures. In one order of all shingles, two sets of a similarity of t or more share one of
   the first n - ceil(t n) + 1 of each set of n (prefix filter): no pair is lost, whatever the
   order. Shingles that are frequent in a bounded sample come last in it, so a common line seldom
   signs. The sample decides nothing but the cost.
2. Stars. In each block, the documents of one signature, one member is held against all others
   of a size that allows the similarity.
3. Sieve. A sketch holds the parity of a set's hashes in each of one to four times as many bits as
   the set has shingles. Sketches never differ in more bits than the sets differ in shingles, so a pair whose
   sketches are too far apart is no near copy. The texts of pairs that remain are compared by
   their words, and the pairs linked.
4. Rest. Members of a block that are not yet of one component are held against each other, if
   their sizes and sketches allow it. Of blocks with the same members (by count and two sums of
   hashes) one is enough, and of a pair the block of its first common signature, as far as both
   have few enough signatures to carry them along. Blocks are dealt in chunks of at most ``CHUNK_ROWS`` members, each two
   chunks of a block to a task. These pairs are compared by their words and linked likewise.
5. Components of all links, of fingerprints and of words, by simhash.components.

Behaviour: null text counts as empty. Texts without words are copies of each other; one with
fewer words than a shingle is one shingle. Rows without doc_id stay. An empty table gives an
empty result. Signatures are 64-bit hashes; the verification compares words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable, text_or_empty
from tessera.llm.simhash import CHUNK, components, near_duplicates, xxh64

#: The similarity is OF / IN.
SHINGLE, OF, IN = 5, 4, 5
#: Documents of the sample, how many of them a frequent shingle is in, and such shingles at most: they bear on cost, not on results.
SAMPLE, OFTEN, MOST_FREQUENT = 20_000, 20, 100_000
#: Bits of the shortest and the longest sketch, powers of two. Rows that are compared at once with a block.
LEAST_BITS, MOST_BITS, BLOCK = 256, 1 << 14, 256
#: Bits of a sketch for each shingle, in sketches of up to WIDE bits: the more, the less two differences fall on one bit.
ROOMY, WIDE = 4, 1 << 12
#: Texts that a task has as Python objects at once.
AT_ONCE = 200
#: Members of a block's chunk. Signatures that a member carries along, at most.
CHUNK_ROWS, CARRIED = 4_096, 64
#: Ids of the texts to verify are sent to the tasks up to so many; beyond it the texts are dealt by id.
MOST_SENT = 1 << 20
#: Stars of a block have one of so many orders of documents.
ORDERS = 64

PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, once each, in ascending order."""
    words = text.encode().lower().split()
    found, step = [], max(1, CHUNK // 8)
    for a in range(0, max(len(words) - shingle + 1, 1), step):
        part = words[a : a + step + shingle - 1]
        size = np.array([len(w) for w in part] or [0])
        end = np.cumsum(size + 1) - 1
        n = max(len(part) - shingle + 1, 1)
        start = (end - size)[:n]
        found.append(xxh64(b" ".join(part), start, end[min(shingle, len(size)) - 1 :][:n] - start))
    return np.unique(np.concatenate(found))


def shingle_set(text: str, shingle: int = SHINGLE) -> set[bytes]:
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + shingle]) for k in range(max(len(words) - shingle + 1, 1))}


def are_near(x: set[bytes], y: set[bytes]) -> bool:
    both = len(x & y)
    return IN * both >= OF * (len(x) + len(y) - both)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(a, AT_ONCE) for a in range(0, batch.num_rows, AT_ONCE))


def frequent(texts: DataFrame) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts, in ascending order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text).view(np.int64))], names=["h"])

    part = SAMPLE / max(texts.count(), 1)
    drawn = texts if part >= 1 else texts.filter(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(part * 1_000_000))
    counts = drawn.select("text").mapInArrow(task, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    found = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toPandas()["h"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def sketch_of(hashes: np.ndarray) -> bytes:
    """The parity of the hashes in each of so many bits: ROOMY for each hash up to WIDE, then one for each, or the next power of two within LEAST_BITS and MOST_BITS."""
    want = max(min(ROOMY * len(hashes), WIDE), len(hashes), 1)
    bits = min(max(LEAST_BITS, 1 << (want - 1).bit_length()), MOST_BITS)
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: int, bits: int, to: int) -> int:
    """A sketch of more bits as one of fewer; both are powers of two."""
    while bits > to:
        bits //= 2
        sketch = (sketch >> bits) ^ (sketch & ((1 << bits) - 1))
    return sketch


def may_be_near(x: bytes, y: bytes, size: int) -> bool:
    """Whether sets of these sketches, of size shingles together, can be near copies."""
    bits = 8 * min(len(x), len(y))
    apart = (folded(int.from_bytes(x), 8 * len(x), bits) ^ folded(int.from_bytes(y), 8 * len(y), bits)).bit_count()
    return apart * (OF + IN) <= size * (IN - OF)


def signed(texts: DataFrame) -> DataFrame:
    """node, size, sketch, keys of each text: the size of its set, its sketch, and the signatures."""
    often = frequent(texts)
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, sketches, keys = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text)
                late = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h if len(often) else np.zeros(len(h), bool)
                sizes.append(len(h))
                sketches.append(sketch_of(h))
                keys.append(np.concatenate([h[~late], h[late]])[: len(h) - -(-OF * len(h) // IN) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return texts.mapInArrow(task, schema)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Each pair once, the smaller node second."""
    x, y = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    both = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=PAIR.names)


def _of_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The key of each block of a batch and its members, by column."""
    lists = batch.column("members")
    ends, flat = lists.offsets.to_numpy(), lists.values
    columns = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    for k, key in enumerate(batch.column("key").to_pylist()):
        yield key, {c: v[ends[k] : ends[k + 1]] for c, v in columns.items()}


def _first_shared(key: int, keys: np.ndarray, sets: dict[int, set[int]], i: int, j: int) -> bool:
    """Whether key is the least that members i and j have in common; true where one carries none."""
    for k in (i, j):
        if k not in sets:
            sets[k] = set() if keys[k] is None else set(keys[k].tolist())
    return not sets[i] or not sets[j] or min(sets[i] & sets[j]) == key


def _folded_rows(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches of one length as rows of fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _apart(sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the shorter sketch, rows it is compared with, their sketches at that length) for each length."""
    length = np.array([len(x) for x in sketches])
    for n in np.unique(length):
        own, every = np.flatnonzero(length == n), np.flatnonzero(length >= n)
        at = np.empty((len(sketches), n // 8), np.uint64)
        for m in np.unique(length[every]):
            rows = np.flatnonzero(length == m)
            at[rows] = _folded_rows(np.frombuffer(b"".join(sketches[i] for i in rows), np.uint64).reshape(len(rows), -1), n // 8)
        yield own, every, at


def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block's members of different components that size and sketch allow."""
    for batch in batches:
        a, b = [], []
        for key, m in _of_blocks(batch):
            sets: dict[int, set[int]] = {}
            comp, node, size = (m[c].astype(np.int64) for c in ("comp", "node", "size"))
            for own, every, at in _apart(m["sketch"].tolist()):
                for k in range(0, len(own), BLOCK):
                    i = own[k : k + BLOCK]
                    fits = (comp[i][:, None] != comp[every][None, :]) & (IN * np.minimum(size[i][:, None], size[every][None, :]) >= OF * np.maximum(size[i][:, None], size[every][None, :]))
                    x, y = np.nonzero(fits)
                    step = max(1, (1 << 19) // at.shape[1])
                    for p in range(0, len(x), step):
                        u, v = i[x[p : p + step]], every[y[p : p + step]]
                        on = np.bitwise_count(at[u] ^ at[v]).sum(axis=1, dtype=np.int64) * (OF + IN) <= (size[u] + size[v]) * (IN - OF)
                        u, v = u[on], v[on]
                        here = np.array([_first_shared(key, m["keys"], sets, i, j) for i, j in zip(u.tolist(), v.tolist())], dtype=bool)
                        a.append(node[u[here]])
                        b.append(node[v[here]])
        yield _pairs(a, b)


def sieved(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [may_be_near(x, y, m + n) for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "m", "n")))]
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    of_b = pairs.join(marks.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("n")), "b")
    both = of_b.join(marks.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("m")), "a")
    return both.select("a", "b", "x", "y", "m", "n").mapInArrow(task, PAIR)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root: the pairs whose texts are near copies."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, set()
        for batch in _slices(batches):
            on = []
            for x, y in zip(batch.column("text").to_pylist(), batch.column("other").to_pylist()):
                if y != last:
                    last, of_last = y, shingle_set(y)
                on.append(are_near(shingle_set(x), of_last))
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_())).rename_columns(["node", "root"])

    if 2 * pairs.count() <= MOST_SENT:
        texts = texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi")
    of_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    both = of_b.join(texts.withColumnRenamed("node", "a"), "a").select("a", "b", "text", "other")
    return both.mapInArrow(task, "node long, root long")


def shared_signatures(marks: DataFrame) -> DataFrame:
    """key, node, size, root, root_size, members of each signature that several documents have; root is one of them."""
    keys = marks.select(F.explode("keys").alias("key"), "node", "size")
    order = F.xxhash64(F.pmod("key", F.lit(ORDERS)), "node")
    tally = keys.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "size")).alias("least"), F.count(F.lit(1)).alias("members"))
    several = tally.filter("members > 1").select("key", F.col("least.node").alias("root"), F.col("least.size").alias("root_size"), "members")
    return keys.join(several, "key")


def open_blocks(shared: DataFrame, marks: DataFrame, roots: DataFrame) -> DataFrame:
    """key, members of each two chunks of every block that has members of several components."""
    carried = F.when(F.size("keys") <= CARRIED, F.col("keys")).alias("keys")
    comp = durable(marks.select("node", "sketch", carried).join(roots, "node", "left").select("node", "sketch", "keys", F.coalesce("root", "node").alias("comp")), "named-marks")
    named = shared.select("key", "node", "size", "members").join(comp.select("node", "comp"), "node")
    sums = [F.sum(F.xxhash64(F.lit(k), "node", "size").cast("decimal(20,0)")).alias(f"sum{k}") for k in (0, 1)]
    spread = named.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("n"), *sums).filter("least < most")
    wanted = durable(spread.groupBy("n", "sum0", "sum1").agg(F.min("key").alias("key")).select("key"), "open-keys")
    chunks = F.ceil(F.col("members") / CHUNK_ROWS).cast("int")
    rows = shared.select("key", "node", "size", "members").join(wanted, "key", "left_semi").join(comp, "node")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    dealt = rows.withColumns({"chunk": chunk, "with": F.explode(F.sequence(F.lit(0), chunks - 1))})
    member = F.struct("node", "size", "sketch", "keys", "comp")
    return dealt.groupBy("key", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high")).agg(F.collect_list(member).alias("members")).select("key", "members")


def fingerprint_links(texts: DataFrame) -> DataFrame:
    """node, root: each text that op8's fingerprints link to one of a smaller node, and the smallest of these."""
    found = near_duplicates(texts.select(F.col("node").alias("doc_id"), "text"))
    return found.filter("doc_id <> component_id").select(F.col("doc_id").alias("node"), F.col("component_id").alias("root"))


def near_links(docs: DataFrame) -> DataFrame:
    """node, root: the smallest doc_id of the component of every document that has a near copy of a smaller one."""
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), text_or_empty().alias("text"))
    alike = durable(fingerprint_links(texts), "fingerprint-links")
    marks = durable(signed(texts), "signed")
    shared = durable(shared_signatures(marks), "shared-signatures")
    fits = F.least("size", "root_size") * IN >= F.greatest("size", "root_size") * OF
    pairs = shared.filter((F.col("node") != F.col("root")) & fits).select(F.greatest("node", "root").alias("a"), F.least("node", "root").alias("b")).distinct()
    first = durable(alike.unionAll(verified(durable(sieved(pairs, marks), "star-pairs"), texts)), "first-links")
    roots = components(first)
    pairs = open_blocks(shared, marks, roots).mapInArrow(crossing, PAIR).distinct()
    rest = durable(verified(durable(pairs, "crossing-pairs"), texts), "crossing-links")
    return components(first.unionAll(rest)) if rest.head(1) else roots


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component, with all their columns; rows without an id stay."""
    gone = near_links(docs).select(F.col("node").alias("_tessera_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_tessera_id"), "left_anti")

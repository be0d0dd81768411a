"""SimHash near-duplicates: fingerprints, vantage-point shards, and components of linked documents.

1. Fingerprints. Word shingles are hashed by XXH64 over whole texts, vectorised in tasks.
2. Classes. Documents of one fingerprint are one class, named by its smallest doc_id.
3. Shards. A vantage-point tree over a bounded sample of classes splits the space: a class
   goes inside a vantage point's radius or outside. Two fingerprints at ``radius`` bits or
   fewer have a midpoint within half of that from both, so a class is also sent to every
   shard that its ball of half the radius touches by the triangle inequality: the pair meets
   in the midpoint's shard. Nothing but the tree (one node a split, ``TREE`` at most) is sent
   to the tasks. Shards that are larger than ``MOST_ROWS`` are split on, by a vantage point and
   median of their own, which are joined to their rows; what no vantage point splits is dealt
   in chunks, each two of a shard to a task.
4. Links. Within a shard the same splitting goes on until blocks are small enough to compare
   outright. A shard returns its links as stars around the smallest doc_id of each local
   component, so a dense group gives a link a class, not all pairs.
5. Components. Large-star and small-star rounds over the links until nothing changes, each
   round a written table; a component's name is the smallest doc_id in it.

Behaviour: null text counts as empty. A text without words has fingerprint zero and is
linked like any other; one with fewer words than a shingle is one shingle. Rows that repeat a
doc_id are answered each. Rows with null doc_id get their class's component, null if the
class has no other id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, durable, table, text_or_empty

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Classes of the sample that the tree is built from, its leaves at most, and classes a leaf is meant for.
SAMPLE, TREE, SHARD = 65_536, 4_096, 2_500
#: Classes of a shard beyond which it is split on, and rounds of that after which its rest is dealt in chunks.
MOST_ROWS, ROUNDS, SALTS = 20_000, 40, 64
#: Fingerprints that are compared outright.
BLOCK = 384
#: Bytes of text hashed at once.
CHUNK = 1 << 20

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(raw: bytes, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of raw[start : start + size] for each start, as uint64."""
    padded = raw + bytes(16)
    lanes = np.empty(len(raw) + 8, np.uint64)  # the eight bytes from every position
    for k in range(8):
        part = lanes[k::8]
        part[:] = np.frombuffer(padded, "<u8", count=len(part), offset=k)
    seed64 = np.array([seed], np.uint64)  # an array, whose arithmetic wraps without warnings
    out = np.repeat(seed64 + P5, len(start))
    at, left = start.astype(np.int64), size.astype(np.int64).copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        acc = [np.repeat(x, len(long)) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
        pos, stripes = at[long].copy(), size[long] // 32
        for k in range(int(stripes.max())):
            on = np.flatnonzero(stripes > k)
            for j in range(4):
                acc[j][on] = _rotl(acc[j][on] + lanes[pos[on] + 8 * j] * P2, 31) * P1
            pos[on] += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ (_rotl(a * P2, 31) * P1)) * P1 + P4
        out[long] = h
        at[long] = pos
        left[long] -= stripes * 32
    out += size.astype(np.uint64)
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        out[on] = _rotl(out[on] ^ (_rotl(lanes[at[on]] * P2, 31) * P1), 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    out[on] = _rotl(out[on] ^ ((lanes[at[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        out[on] = _rotl(out[on] ^ ((lanes[at[on]] & np.uint64(0xFF)) * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    out = (out ^ (out >> np.uint64(33))) * P2
    out = (out ^ (out >> np.uint64(29))) * P3
    return out ^ (out >> np.uint64(32))


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set, in every run of hashes that begins at first."""
    ends = np.append(first[1:], len(hashes))
    runs = np.concatenate([np.arange(a, b, 255) for a, b in zip(first, ends)])  # byte counters hold 255
    of = np.searchsorted(first, runs, side="right") - 1
    counts = np.zeros((len(first), 64), np.int64)
    for k in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), runs)
        np.add.at(counts, (of[:, None], np.arange(8)[None, :] * 8 + k), packed.view(np.uint8).reshape(-1, 8))
    return counts


def fingerprints(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text, as uint64."""
    totals, numbers = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)

    def flush(parts: list[bytes], owners: list[int]) -> None:
        raw = b" ".join(parts)
        word_end = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))
        word_start = np.append(0, word_end[:-1] + 1)
        sizes = np.array([p.count(b" ") + 1 for p in parts])
        base = np.cumsum(sizes) - sizes
        n = np.maximum(sizes - shingle + 1, 1)
        first = np.cumsum(n) - n
        word = np.arange(n.sum()) + np.repeat(base - first, n)
        last = word + np.repeat(np.minimum(sizes, shingle), n) - 1
        start = word_start[word]
        hashes = xxh64(raw, start, word_end[last] - start)
        np.add.at(totals, owners, bit_counts(hashes, first))
        np.add.at(numbers, owners, n)

    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        words = text.encode().lower().split()  # bytes: lower-cases A-Z alone, splits at the six ASCII blanks
        step = max(1, CHUNK // 8)
        for a in range(0, max(len(words) - shingle + 1, 1) if words else 0, step):  # long texts in parts that share shingle - 1 words
            part = b" ".join(words[a : a + step + shingle - 1])
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held >= CHUNK:
                flush(parts, owners)
                parts, owners, held = [], [], 0
    if parts:
        flush(parts, owners)
    bits = (totals * 2 > numbers[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed long."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column("text").to_pylist(), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=schema.names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(task, schema)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """A vantage point and its radius: of a few candidates the one that spreads distances most."""
    some = points[rng.integers(0, len(points), 256)] if len(points) > 256 else points
    spread, best = max((float(np.bitwise_count(some ^ v).std()), v) for v in rng.choice(points, 8))
    return best, int(np.median(np.bitwise_count(points ^ best)))


def shard_tree(sample: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inside, outside); a negative child ~k is shard k."""
    rng, nodes, made = np.random.default_rng(SEED), [], 0

    def build(points: np.ndarray, want: int) -> int:
        nonlocal made
        if want > 1 and len(points) >= 16:
            v, mu = _split(points, rng)
            inside = np.bitwise_count(points ^ v) <= mu
            if 0 < inside.sum() < len(points):
                at = len(nodes)
                nodes.append(())
                nodes[at] = (int(v), mu, build(points[inside], want // 2), build(points[~inside], want - want // 2))
                return at
        made += 1
        return ~(made - 1)

    build(sample, shards)
    return nodes


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], half: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) for every shard that the ball of half around a fingerprint touches."""
    rows, shards, todo = [], [], [(0 if nodes else ~0, np.arange(len(fps)))]
    while todo:
        at, own = todo.pop()
        if at < 0:
            rows.append(own)
            shards.append(np.full(len(own), ~at))
            continue
        v, mu, inside, outside = nodes[at]
        d = np.bitwise_count(fps[own] ^ np.uint64(v)).astype(np.int64)
        todo += [(inside, own[d - half <= mu]), (outside, own[d + half > mu])]
    return np.concatenate(rows), np.concatenate(shards)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _compare(fps: np.ndarray, own: np.ndarray, other: np.ndarray, radius: int, parent: np.ndarray) -> None:
    """Join own and other rows within radius, by the smaller row of each pair."""
    near = np.bitwise_count(fps[own][:, None] ^ fps[other][None, :]) <= radius
    a, b = np.nonzero(near)
    keep = own[a] < other[b]
    for i, j in zip(own[a[keep]].tolist(), other[b[keep]].tolist()):
        x, y = _find(parent, i), _find(parent, j)
        if x != y:
            parent[max(x, y)] = min(x, y)


def shard_links(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its local component: rows within radius bits are linked."""
    parent, rng, half = np.arange(len(fps)), np.random.default_rng(SEED), (radius + 1) // 2
    todo = [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        if len(own) > BLOCK:
            v, mu = _split(fps[own], rng)
            d = np.bitwise_count(fps[own] ^ v).astype(np.int64)
            sides = [own[d - half <= mu], own[d + half > mu]]
            if max(map(len, sides)) < 0.9 * len(own):
                todo += sides
                continue
        for a in range(0, len(own), BLOCK):
            for b in range(a, len(own), BLOCK):
                _compare(fps, own[a : a + BLOCK], own[b : b + BLOCK], radius, parent)
    return np.array([_find(parent, i) for i in range(len(fps))], dtype=np.int64)


def _salted(rows: DataFrame, small: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """rows joined with small (a row a key) by key and a salt of the row, so that a key's rows are dealt over many tasks."""
    dealt = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("fp", "node"), F.lit(salts))).join(dealt, [key, "_salt"]).drop("_salt")


def split_on(routed: DataFrame, most_rows: int, half: int) -> DataFrame:
    """Rows (shard, fp, node) as (shard, low, high, fp, node): no (shard, low, high) has more than about two times most_rows."""
    done = []
    for k in range(ROUNDS):
        sizes = durable(routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64(F.lit(k), "fp"), "fp")).alias("v")), "shard-sizes")
        large = sizes.filter(F.col("n") > most_rows).select("shard", F.col("v.fp").alias("vantage"), "n")
        if large.isEmpty():
            break
        apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
        held = durable(_salted(routed, large, "shard").withColumn("d", apart), "shard-large")
        middle = held.groupBy("shard").agg(F.percentile_approx("d", 0.5).alias("mu"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        sides = _salted(held.select("shard", "fp", "node", "d"), middle.select("shard", "mu"), "shard")
        sides = sides.withColumn("side", F.explode(F.array_compact(F.array(F.when(F.col("d") - half <= F.col("mu"), 0), F.when(F.col("d") + half > F.col("mu"), 1)))))
        sides = durable(sides.select("shard", "fp", "node", "side"), "shard-sides")
        grown = sides.groupBy("shard", "side").count().groupBy("shard").agg(F.max("count").alias("most")).join(large.select("shard", "n"), "shard")
        stuck = grown.filter(F.col("most") > 0.9 * F.col("n")).select("shard", F.col("n").alias("stuck"))
        done.append(routed.join(sizes.filter(F.col("n") <= most_rows).select("shard"), "shard", "left_semi").withColumn("n", F.lit(1).cast("long")))
        done.append(routed.join(stuck, "shard").withColumnRenamed("stuck", "n"))
        routed = durable(sides.join(stuck, "shard", "left_anti").select(F.xxhash64("shard", "side", F.lit(k)).alias("shard"), "fp", "node"), "shard-split")
    done.append(routed.join(routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "shard"))
    for k, part in enumerate(done):
        chunks = F.ceil(F.col("n") / most_rows).cast("int")
        chunk = F.pmod(F.xxhash64("fp"), chunks).cast("int")
        dealt = part.withColumns({"chunk": chunk, "with": F.explode(F.sequence(F.lit(0), chunks - 1))})
        done[k] = dealt.select("shard", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "fp", "node")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def links(classes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD, tree: int = TREE, most_rows: int = MOST_ROWS) -> DataFrame:
    """node, root: star links between classes (fp, node) within radius bits."""
    n = classes.count()
    shards, nodes = min(tree, -(-n // shard_rows)), []
    if shards > 1:  # about SAMPLE fingerprints by a digest: the same at every run, and no more from more tasks
        drawn = classes.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / n) * (1 << 40)))
        sample = np.array([r["fp"] for r in drawn.select("fp").collect()], dtype=np.int64).view(np.uint64)
        nodes = shard_tree(np.sort(sample), shards)
    half = (radius + 1) // 2
    routed = T.StructType([T.StructField("shard", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("node", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            row, shard = route(fp.view(np.uint64), nodes, half)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(fp[row]), pa.array(node[row])], names=routed.names)

    found = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])

    def link(shard: pa.Table) -> pa.Table:
        fp, node = shard.column("fp").to_numpy(), shard.column("node").to_numpy()
        order = np.argsort(node)
        fp, node = fp[order], node[order]
        root = node[shard_links(fp.view(np.uint64), radius)]
        on = root != node
        return pa.table({"node": node[on], "root": root[on]})

    dealt = durable(classes.select("fp", "node").mapInArrow(deal, routed), "shards")
    return split_on(dealt, most_rows, half).groupBy("shard", "low", "high").applyInArrow(link, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of edges (node, root) reaches."""
    now, seen = durable(edges.select(F.greatest("node", "root").alias("a"), F.least("node", "root").alias("b")), "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, last = state, now
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.filter("a <> b").distinct(), "large-star")
        lower = durable(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(lower.select("a", F.col("m").alias("b")))
        now = durable(small.filter("a <> b").distinct(), "links")
        discard(last, least, large, lower)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id; one row for each row of docs."""
    marked = durable(with_fingerprints(docs, shingle), "fingerprints")
    classes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-classes")
    roots = components(links(classes.filter("node IS NOT NULL"), radius))
    named = durable(classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "named-classes")
    # a class is first spread to the salts that it has: rows of one fingerprint are dealt over many tasks
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = salted.select("fp", "salt").distinct().join(named, "fp")
    return salted.join(spread, ["fp", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs whose doc_id names their component, with all their columns; rows without an id stay."""
    keep = near_duplicates(docs, **settings).filter("doc_id = component_id").select(F.col("doc_id").alias("_tessera_id")).distinct()
    return docs.join(keep, F.col("doc_id") == F.col("_tessera_id"), "left_semi").unionAll(docs.filter("doc_id IS NULL"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Removal of repeated byte strings with a sparse suffix array.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier (smaller doc_id, or
earlier in the same document). Strings never cross documents and are judged on the input.

1. Anchors. In every LENGTH-byte string the position of its smallest ``GRAM``-byte hash is its
   anchor, so equal strings have equal anchors, and about one position in 35 is one. The
   strings of an anchor lie within its context: LENGTH - GRAM bytes before it and LENGTH after.
2. Whole contexts. Anchors are dealt by hash and sorted. Where one with the same context stands
   earlier, all its strings repeat. Contexts are equal here if their keyed 128-bit BLAKE2b digests
   are, which take in the context and its lengths: 2^40 contexts hold two unequal ones of one
   digest with a probability of 2^-49, and to make two takes about 2^64 tries. Tasks combine
   theirs first, so copies cost a row a task. Of an anchor with several contexts, the first row
   of each goes on.
3. Suffix sort. The contexts of these are cut from the texts and the suffixes that begin at
   anchors are put in order by mergesort. A comparison finds the common extension of two
   suffixes by binary search over their prefix polynomial hashes and looks at one byte after
   it. Extensions of neighbours are then verified byte by byte; where a hash deceived, the
   suffixes are sorted by their bytes. For every distance between string start and anchor, equal strings are
   those within one run of common extensions whose bytes before the anchor are equal as well
   (prefix hashes backwards, verified by bytes); all but the earliest repeat.
4. Hot anchors, with more than ``HOT`` contexts (a short phrase that a great many texts share),
   would gather in one task. Their strings are dealt one by one instead, by their bytes, and
   sorted: all but the first of equal strings repeat. Tasks combine equal strings first. The
   answer is the same as by step 3, whatever HOT is.
5. Repeats become spans of bytes per document, which are merged and cut out of its text.

Before that, in step 2, a flush that meets ``HEAVY`` contexts of one anchor deals them to many tasks by
context, with a marker row wherever rows of that anchor can be, which tells that it has
several contexts.

Behaviour: null text counts as empty. Null doc_ids come before all others, in the order of a
hash of their text. Rows that repeat a doc_id and text are one document and get the same answer;
unequal texts under one doc_id are ordered by a hash. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import durable, table, text_or_empty

LENGTH, GRAM = 100, 32
BEFORE = LENGTH - GRAM
#: Key of the digests of contexts.
DIGEST_KEY = b"contexts of anchors"
#: Windows of GRAM-byte hashes in a string.
SPAN = LENGTH - GRAM + 1
#: Bytes hashed at once, and of a document's text in one part; positions take 20 bits.
CHUNK = 1 << 19
#: Anchors that a task holds before it passes them on; contexts of one anchor in them that make it a hot one.
FLUSH, HEAVY = 1_000_000, 1_000
#: Contexts of one anchor that are sorted together, and rows in one call; strings of hot anchors that a task combines.
HOT, AT_ONCE, STRINGS = 2_000, 30_000, 100_000
#: Hot anchors are sent to the tasks up to so many.
MOST_SENT = 1 << 20

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, size=(2, 257), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 5)


def _powers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base k modulo 2^64, and of its inverse."""
    if k not in _POWERS:
        n, mod = 2 * CHUNK, 1 << 64
        both = []
        for base in (_BASES[k], pow(_BASES[k], -1, mod)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[k] = tuple(both)
    return _POWERS[k]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Prefix polynomial hashes of a buffer."""

    def __init__(self, raw: np.ndarray, k: int):
        up, self.down = _powers(k)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[k][raw] * up[: len(raw)], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return (self.sums[n:] - self.sums[:m]) * self.down[:m]


def context_digests(raw: bytes, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Keyed 128-bit digests, as two numbers, of raw[a:b] around q with the lengths on both sides of q."""
    keyed = hashlib.blake2b(key=DIGEST_KEY, digest_size=16)
    found = bytearray()
    for i, j, k in zip(a.tolist(), b.tolist(), q.tolist()):
        digest = keyed.copy()
        digest.update(raw[i:j] + bytes((k - i, j - k)))
        found += digest.digest()
    return np.frombuffer(bytes(found), np.int64).reshape(-1, 2)


def anchors(raw: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Anchors of the strings that start in parts of a buffer.

    Part k holds raw[low[k] : high[k]]; its strings start at first[k] to last[k] - 1. Returns rows
    (hash, digest of the context in two numbers, part, position, first start, last start).
    """
    kept = last > first
    if not kept.any():
        return np.zeros((0, 7), np.int64)
    grams = _mix(Prefixes(raw, 0).grams(GRAM))
    mask = np.uint64((1 << 20) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    n = np.where(kept, last - first, 0)
    part = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    at = (least[start] & mask).astype(np.int64)
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])))
    end = np.append(new[1:], len(at)) - 1
    q, part = at[new], part[new]
    a, b = np.maximum(q - BEFORE, low[part]), np.minimum(q + LENGTH, high[part])
    context = context_digests(raw.tobytes(), a, b, q)
    return np.stack([grams[q].view(np.int64), *context.T, part, q, start[new], start[end]], axis=1)


def text_anchors(texts: list[bytes]) -> np.ndarray:
    """Rows (hash, digest of the context in two numbers, text number, position, first start, last start) over all texts."""
    found, parts, held = [], [], 0

    def flush() -> None:
        nonlocal parts, held
        raw = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
        sizes = np.array([len(p[0]) for p in parts])
        low = np.cumsum(sizes) - sizes
        number, offset, first, last, own_a, own_b = (np.array([p[k] for p in parts]) for k in range(1, 7))
        shift = low - offset
        rows = anchors(raw, first + shift, last + shift, low, low + sizes)
        k = rows[:, 3]
        rows[:, 4:7] -= shift[k][:, None]
        mine = (rows[:, 5] >= own_a[k]) & (rows[:, 5] < own_b[k])
        rows[:, 3] = number[k]
        found.append(rows[mine])
        parts, held = [], 0

    for i, text in enumerate(texts):
        starts = len(text) - LENGTH + 1
        for a in range(0, max(starts, 0), CHUNK // 2):  # a part answers for the anchors whose first string starts in it
            first, last = max(0, a - 1), min(starts, a + CHUNK // 2 + SPAN)
            lo, hi = max(0, first - BEFORE), min(len(text), last + LENGTH + BEFORE)
            parts.append((text[lo:hi], i, lo, first, last, a, a + CHUNK // 2))
            held += hi - lo
            if held >= CHUNK // 2:
                flush()
    if parts:
        flush()
    return np.concatenate(found) if found else np.zeros((0, 7), np.int64)


def merge_sort(forward: np.ndarray, size: np.ndarray, raw: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows in the order of (group, suffix); group ascends. forward: prefix hashes of each row's suffix.

    Runs double in width. A row's new place is its place in its own run plus the number of rows
    of the sibling run before it, found by binary search; a comparison is itself a binary
    search for the common extension.
    """
    n = len(group)
    order = np.arange(n)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    gs, ge = begin[of], np.append(begin[1:], n)[of]
    width, longest = 1, int((ge - gs).max()) if n else 0
    while width < longest:
        index = np.arange(n) - gs
        run = index // width
        sib_lo = gs + (run ^ 1) * width
        sib_hi = np.minimum(sib_lo + width, ge)
        lo, hi = np.minimum(sib_lo, ge), np.maximum(sib_hi, np.minimum(sib_lo, ge))
        left = run % 2 == 0
        while True:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                break
            mid = (lo[on] + hi[on]) // 2
            a, b = order[mid], order[on]
            ext = extension(forward, size, a, b)
            short = np.minimum(size[a], size[b])
            at = np.minimum(ext, raw.shape[1] - 1)
            by_byte = raw[a, at].astype(np.int64) - raw[b, at]
            sign = np.where(ext < short, by_byte, size[a] - size[b])
            before = (sign < 0) | ((sign == 0) & ~left[on])  # equal rows keep their order
            lo[on] = np.where(before, mid + 1, lo[on])
            hi[on] = np.where(before, hi[on], mid)
        rank = lo - np.minimum(sib_lo, ge)
        moved = np.empty(n, np.int64)
        moved[gs + (run // 2) * 2 * width + index - run * width + rank] = order
        order, width = moved, width * 2
    return order


def extension(forward: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b by their prefix hashes, in logarithmic steps."""
    lo, hi = np.zeros(len(a), np.int64), np.minimum(size[a], size[b])
    while True:
        on = np.flatnonzero(lo < hi)
        if not len(on):
            return lo
        mid = (lo[on] + hi[on] + 1) // 2
        same = forward[a[on], mid] == forward[b[on], mid]
        lo[on] = np.where(same, mid, lo[on])
        hi[on] = np.where(same, hi[on], mid - 1)


def row_prefixes(raw: np.ndarray, k: int) -> np.ndarray:
    """Prefix hashes of every row of a byte matrix, 0 to its width."""
    out = np.zeros((len(raw), raw.shape[1] + 1), np.uint64)
    np.cumsum(_BYTES[k][raw] * _powers(k)[0][: raw.shape[1]], axis=1, out=out[:, 1:])
    return out


def padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def repeats(group: np.ndarray, right: list[bytes], left: list[bytes], least: np.ndarray, most: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which strings repeat: a row for each context, a column for each distance from string start to anchor.

    right: the bytes from the anchor on; left: those before it, backwards; least and most: the
    distances that are the anchor's; rank: contexts from the earliest on (equal for one place).
    """
    n = len(group)
    size = np.array([len(r) for r in right], dtype=np.int64)
    raw, back = padded(right, LENGTH), padded(left, BEFORE)
    forward = row_prefixes(raw, 0)
    order = merge_sort(forward, size, raw, group)
    a, b = order[:-1], order[1:]
    ext = np.where(group[a] == group[b], extension(forward, size, a, b), 0)
    # verified: no difference before the extension's end, and one at it where both suffixes go on
    unequal = (raw[a] != raw[b]).argmax(axis=1)
    unequal = np.where((raw[a] == raw[b]).all(axis=1), LENGTH, unequal)
    true_ext = np.where(group[a] == group[b], np.minimum(unequal, np.minimum(size[a], size[b])), 0)
    if (true_ext != ext).any():
        order = np.array(sorted(range(n), key=lambda i: (group[i], right[i])), dtype=np.int64)
        a, b = order[:-1], order[1:]
        unequal = np.where((raw[a] == raw[b]).all(axis=1), LENGTH, (raw[a] != raw[b]).argmax(axis=1))
        ext = np.where(group[a] == group[b], np.minimum(unequal, np.minimum(size[a], size[b])), 0)
    backward = row_prefixes(back, 1)
    out = np.zeros((n, BEFORE + 1), bool)
    for o in range(BEFORE + 1):
        use = (least[order] <= o) & (o <= most[order])
        if not use.any():
            continue
        cls = np.cumsum(np.append(0, ext < LENGTH - o))[use]
        own = order[use]
        h = backward[own, o]
        by = np.lexsort((rank[own], h, cls))
        cls, h, own = cls[by], h[by], own[by]
        new = np.append(True, (cls[1:] != cls[:-1]) | (h[1:] != h[:-1]))
        head = own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        again = ~new & (rank[own] != rank[head])
        wrong = again & (back[own, :o] != back[head, :o]).any(axis=1)
        if wrong.any():  # hashes deceived: group by the bytes
            seen: dict = {}
            for k, (c, i) in enumerate(sorted(zip(cls.tolist(), own.tolist()), key=lambda x: rank[x[1]])):
                first = seen.setdefault((c, left[i][:o]), i)
                out[i, o] = rank[i] != rank[first]
        else:
            out[own[again], o] = True
    return out


def join_runs(doc: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """String starts lo to hi of documents, neighbours joined."""
    by = np.lexsort((lo, v, doc))
    doc, v, lo, hi = doc[by], v[by], lo[by], hi[by]
    new = np.append(True, (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (lo[1:] > hi[:-1] + 1))[: len(doc)]
    first = np.flatnonzero(new)
    return doc[first], v[first], lo[first], np.maximum.reduceat(hi, first) if len(first) else hi


# Rows between the steps. kind 0: an anchor (h, digest ctx and ctx2, position q, its string starts lo to hi);
# 1: string starts lo to hi repeat; 2: an anchor whose context is one of several; 3: a marker of a hot anchor.
ROW = T.StructType([T.StructField(c, T.LongType()) for c in ("spread", "h", "ctx", "ctx2", "kind", "doc", "v", "q", "lo", "hi")])


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=ROW.names)


def _combined(rows: np.ndarray, heavy: int = HEAVY) -> Iterator[pa.RecordBatch]:
    """rows (h, ctx, ctx2, doc, v, q, lo, hi) of a flush: the first of every context, the rest as repeats."""
    rows = rows[np.lexsort(rows[:, 5::-1].T)]
    new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))
    head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    same = (rows[:, 3:6] == rows[head, 3:6]).all(axis=1)  # a row that repeats its document
    again = rows[~new & ~same]
    doc, v, lo, hi = join_runs(again[:, 3], again[:, 4], again[:, 6], again[:, 7])
    zero = np.zeros(len(doc), np.int64)
    yield _batch([_mix(doc.view(np.uint64)).view(np.int64), zero, zero, zero, zero + 1, doc, v, zero, lo, hi])
    first = rows[new]
    h = first[:, 0]
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    count = np.diff(np.append(begin, len(h)))
    hot = np.repeat(count >= heavy, count)
    spread = np.where(hot, _mix(first[:, 1].view(np.uint64)).view(np.int64) >> 56, 0) + h
    yield _batch([spread, *first[:, :3].T, np.zeros(len(h)), *first[:, 3:].T])
    mark = np.repeat(h[begin][count >= heavy], 256)
    zero = np.zeros(len(mark), np.int64)
    yield _batch([mark + np.resize(np.arange(-128, 128), len(mark)), mark, zero, zero, zero + 3, zero, zero, zero, zero, zero])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, ctx, ctx2, kind != 3, doc, v, q): repeats, and the first of each context of an anchor with several."""
    pending, before = np.zeros((0, len(ROW)), np.int64), None  # a first row not yet judged, and the h of the one before it

    def judged(first: np.ndarray, close: bool) -> np.ndarray:
        nonlocal pending, before
        rows = np.concatenate([pending, first])
        if not len(rows):
            return rows
        h = rows[:, 1]
        with_next = np.append(h[1:] == h[:-1], False)
        with_last = np.append(False, h[1:] == h[:-1])
        with_last[0] = before is not None and before == h[0]
        done = rows if close else rows[:-1]
        out = done[(with_next | with_last)[: len(done)] & (done[:, 4] == 0)].copy()
        if not close:
            before = h[-2] if len(h) > 1 else before
            pending = rows[-1:]
        out[:, 4] = 2
        return out

    last = np.zeros((0, len(ROW)), np.int64)  # the first row of the context at hand
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(len(ROW))], axis=1)
        yield _batch(list(rows[rows[:, 4] == 1].T))
        rows = rows[rows[:, 4] != 1]
        if not len(rows):
            continue
        rows = np.concatenate([last, rows])
        new = np.append(True, (rows[1:, 1:5] != rows[:-1, 1:5]).any(axis=1))
        head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        again = ~new & (rows[:, 4] == 0) & (rows[:, 5:8] != rows[head][:, 5:8]).any(axis=1)
        found = rows[again].copy()
        found[:, 4] = 1
        yield _batch(list(found.T))
        fresh = new.copy()
        fresh[0] = new[0] and not len(last)
        yield _batch(list(judged(rows[fresh], False).T))
        last = rows[head[-1:]]
    yield _batch(list(judged(np.zeros((0, len(ROW)), np.int64), True).T))


# kind 0: a context of an anchor (h, position q, its strings' distances least to most, bytes); 1: string starts q to most
# repeat; 2: a string of a hot anchor that starts at q, its bytes in left.
CUT = T.StructType([T.StructField(c, T.LongType()) for c in ("kind", "h", "doc", "v", "q", "least", "most")] + [T.StructField(c, T.BinaryType()) for c in ("left", "right")])
FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("doc", "v", "lo", "hi")])


def _found(doc, v, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, v, lo, hi)], names=FOUND.names)


def _cut_batch(numbers: np.ndarray, left: list[bytes], right: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(numbers[:, k]) for k in range(7)), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=CUT.names)


def _combined_strings(rows: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
    """rows (string, doc, v, start) of a task: the first of equal strings, and the rest as repeats."""
    rows = sorted(set(rows))
    first = [k == 0 or rows[k][0] != rows[k - 1][0] for k in range(len(rows))]
    new = [r for r, on in zip(rows, first) if on]
    again = np.array([r[1:] for r, on in zip(rows, first) if not on], dtype=np.int64).reshape(-1, 3)
    doc, v, lo, hi = join_runs(again[:, 0], again[:, 1], again[:, 2], again[:, 2])
    zero = np.zeros(len(doc), np.int64)
    places = np.array([r[1:] for r in new], dtype=np.int64).reshape(-1, 3)
    none = np.zeros(len(new), np.int64)
    numbers = np.concatenate([np.stack([zero + 1, zero, doc, v, lo, zero, hi], axis=1), np.stack([none + 2, none, *places.T, none, none], axis=1)])
    return _cut_batch(numbers, [b""] * len(doc) + [r[0] for r in new], [b""] * len(numbers))


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of anchors, cut from texts; of hot anchors their strings."""
    held: list[tuple[bytes, int, int, int]] = []
    for batch in batches:
        for part in (batch.slice(a, 200) for a in range(0, batch.num_rows, 200)):
            rows, left, right = [], [], []
            for doc, v, text, at in zip(*(part.column(c).to_pylist() for c in ("doc", "v", "text", "at"))):
                text = text.encode()
                for x in at:
                    q = x["q"]
                    if x["hot"]:
                        held += [(text[k : k + LENGTH], doc, v, k) for k in range(x["lo"], x["hi"] + 1)]
                    else:
                        rows.append((0, x["h"], doc, v, q, q - x["hi"], q - x["lo"]))
                        left.append(text[max(0, q - BEFORE) : q][::-1])
                        right.append(text[q : q + LENGTH])
                if len(held) >= STRINGS:
                    yield _combined_strings(held)
                    held = []
            if rows:
                yield _cut_batch(np.array(rows, dtype=np.int64), left, right)
    if held:
        yield _combined_strings(held)


def _sorted_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """String starts that repeat, from contexts sorted by h and strings sorted by bytes and place."""

    def search(t: pa.Table) -> pa.RecordBatch:
        h, doc, v, q, least, most = (t.column(c).to_numpy() for c in ("h", "doc", "v", "q", "least", "most"))
        by = np.lexsort((q, v, doc))
        step = np.append(0, (doc[by][1:] != doc[by][:-1]) | (v[by][1:] != v[by][:-1]) | (q[by][1:] != q[by][:-1]))[: len(by)]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(step)
        again = repeats(h, t.column("right").to_pylist(), t.column("left").to_pylist(), least, most, rank)
        edge = np.zeros((len(h), 1), bool)
        change = np.diff(np.concatenate([edge, again, edge], axis=1).astype(np.int8), axis=1)
        i, a = np.nonzero(change == 1)
        _, b = np.nonzero(change == -1)
        return _found(doc[i], v[i], q[i] - (b - 1), q[i] - a)

    held: list[pa.Table] = []
    last: tuple = (None, None)  # the string at hand and the place where it starts first

    def drain(all_: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        t = pa.concat_tables(held).combine_chunks() if held else None
        held = []
        if t is None or not t.num_rows:
            return
        h = t.column("h").to_numpy()
        end = len(h)
        if not all_ and h[0] != h[-1]:  # the last anchor's rows may go on
            end = int(np.searchsorted(h, h[-1]))
            held = [t.slice(end)]
        elif not all_:
            held, end = [t], 0
        if end:
            yield search(t.slice(0, end))

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        on = batch.filter(pa.array(kind == 1))
        if on.num_rows:
            yield _found(*(on.column(c).to_numpy() for c in ("doc", "v", "q", "most")))
        on = batch.filter(pa.array(kind == 2))
        if on.num_rows:
            doc, v, q = (on.column(c).to_numpy() for c in ("doc", "v", "q"))
            again = np.zeros(on.num_rows, bool)
            for k, (string, place) in enumerate(zip(on.column("left").to_pylist(), zip(doc.tolist(), v.tolist(), q.tolist()))):
                if string == last[0]:
                    again[k] = place != last[1]
                else:
                    last = (string, place)
            yield _found(doc[again], v[again], q[again], q[again])
        on = batch.filter(pa.array(kind == 0))
        if on.num_rows:
            held.append(pa.Table.from_batches([on]))
            if sum(x.num_rows for x in held) >= AT_ONCE:
                yield from drain(False)
    yield from drain(True)


def identified(docs: DataFrame) -> DataFrame:
    """doc, v, text: an order key for every document; v tells apart unequal texts under one doc_id."""
    text = text_or_empty()
    low = -(1 << 62) + F.xxhash64(text).bitwiseAND((1 << 61) - 1)
    out = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), low).alias("doc"), text.alias("text"))
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("twice"))
    if repeated.isEmpty():
        return out.withColumn("v", F.lit(0).cast("long"))
    keys = out.join(repeated, F.col("doc_id") == F.col("twice"), "left_semi").select("doc", F.xxhash64("text").alias("key")).distinct()
    named = keys.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("key")).cast("long")).withColumnRenamed("doc", "of")
    keyed = out.join(named, (F.col("doc") == F.col("of")) & (F.xxhash64("text") == F.col("key")), "left")
    return keyed.select("doc_id", "doc", "text", F.coalesce("n", F.lit(0)).cast("long").alias("v"))


def remove_repeats(docs: DataFrame, flush: int = FLUSH, heavy: int = HEAVY, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: the bytes that stay, for each row of docs.

    flush, heavy and hot bear on how the work is dealt, not on results.
    """
    texts = identified(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in (batch.slice(a, 2_000) for a in range(0, batch.num_rows, 2_000)):
                rows = text_anchors([t.as_py().encode() for t in part.column("text")])
                doc, v = part.column("doc").to_numpy()[rows[:, 3]], part.column("v").to_numpy()[rows[:, 3]]
                held.append(np.column_stack([rows[:, :3], doc, v, rows[:, 4:]]))
                n += len(rows)
                if n >= flush:
                    yield from _combined(np.concatenate(held), heavy)
                    held, n = [], 0
        if n:
            yield from _combined(np.concatenate(held), heavy)

    dealt = texts.select("doc", "v", "text").mapInArrow(find, ROW).repartition("spread")
    ordered = dealt.sortWithinPartitions("h", "ctx", "ctx2", F.col("kind") != 3, "doc", "v", "q")
    judged = durable(ordered.mapInArrow(_contexts, ROW).select("h", "kind", "doc", "v", "q", "lo", "hi"), "suffix-contexts")

    several = judged.filter("kind = 2").select("h", "doc", "v", "q", "lo", "hi")
    many = durable(several.groupBy("h").count().filter(F.col("count") > hot).select(F.col("h").alias("of"), F.lit(True).alias("hot")), "hot-anchors")
    several = several.join(F.broadcast(many) if many.count() <= MOST_SENT else many, F.col("h") == F.col("of"), "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = several.groupBy(F.col("doc").alias("d"), F.col("v").alias("w")).agg(F.collect_list(F.struct("h", "q", "lo", "hi", "hot")).alias("at"))
    with_text = texts.select("doc", "v", "text").join(wanted, (F.col("doc") == F.col("d")) & (F.col("v") == F.col("w"))).select("doc", "v", "text", "at")
    cut = with_text.mapInArrow(_cut_contexts, CUT)
    contexts = cut.repartition(F.when(F.col("kind") == 0, F.col("h")).when(F.col("kind") == 1, F.xxhash64("doc", "q")).otherwise(F.xxhash64("left")))
    contexts = contexts.sortWithinPartitions("kind", "h", F.when(F.col("kind") == 2, F.col("left")), "doc", "v", "q")
    found = durable(contexts.mapInArrow(_sorted_suffixes, FOUND), "suffix-repeats")
    runs = judged.filter("kind = 1").select("doc", "v", "lo", "hi").unionAll(found)
    spans = runs.groupBy(F.col("doc").alias("d"), F.col("v").alias("w")).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    fields = [docs.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    schema = T.StructType(fields)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                out = []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist()):
                    text, keep, end, removed, spans_ = text.encode(), [], 0, 0, 0
                    last = -1
                    for lo, hi in sorted((r["lo"], r["hi"] + LENGTH) for r in runs or ()):
                        if lo > last:
                            keep.append(text[max(end, 0) : lo])
                            spans_ += 1
                            removed += hi - lo
                            last = hi
                        elif hi > last:
                            removed += hi - last
                            last = hi
                        end = last
                    keep.append(text[end:])
                    kept = b"".join(keep)
                    out.append((len(text), removed, spans_, hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=schema.names)

    full = texts.join(spans, (F.col("doc") == F.col("d")) & (F.col("v") == F.col("w")), "left")
    return full.select("doc_id", "text", "runs").mapInArrow(cut_out, schema)


def op5_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")

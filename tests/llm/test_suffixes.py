from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import suffixes


def brute_force(docs: list[tuple]) -> dict:
    """(doc_id, text) -> (n_bytes, n_removed, n_spans, sha) for unique non-null doc_ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        flags = np.frombuffer(bytes(gone), np.uint8).astype(int)
        spans = int((np.diff(np.append(0, flags)) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc_id] = (len(raw), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed: int, n: int = 60) -> list[tuple]:
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcé "), rng.integers(1, 9)))
    passages = ["".join(word() + " " for _ in range(rng.integers(8, 90))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [passages[rng.integers(len(passages))][int(rng.integers(0, 30)) :] if rng.random() < 0.5 else word() * int(rng.integers(1, 40)) for _ in range(rng.integers(0, 7))]
        docs.append((i * 3, " ".join(parts)))
    docs += [(1000 + i, docs[i][1]) for i in range(10)]
    docs += [(2000, "x" * 900), (2001, "ab" * 300), (2002, None), (2003, ""), (2004, "y" * 99), (2005, "x" * 100)]
    order = rng.permutation(len(docs))
    return [docs[k] for k in order]


def answers(spark, docs: list[tuple], partitions: int = 3) -> dict:
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    assert answers(spark, docs) == brute_force(docs)


def hot_corpus(seed: int, n: int = 150) -> list[tuple]:
    """One phrase with ever other text around it, and one long passage that many texts end or begin with."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abc "), rng.integers(1, 9)))
    phrase, passage = "the very common phrase that all of these share ", "".join(word() for _ in range(60))
    docs = []
    for i in range(n):
        around = ["".join(word() for _ in range(int(rng.integers(0, 12)))) for _ in range(3)]
        docs.append((i, around[0] + phrase + around[1] + (passage if i % 3 else passage[: int(rng.integers(90, 200))]) + around[2] + (phrase if i % 4 == 0 else "")))
    return [docs[k] for k in rng.permutation(n)]


@pytest.mark.parametrize("settings", [{}, {"hot": 5}, {"heavy": 3, "flush": 40}, {"hot": 0, "heavy": 2, "flush": 10}])
def test_hot_anchors_change_nothing(spark, settings):
    docs = hot_corpus(3) + [(1000 + i, t) for i, t in corpus(4, 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(df, **settings).collect()}
    assert got == brute_force(docs)


def test_contexts_of_equal_gram_and_half_a_digest_are_apart():
    """Whole contexts are one only if all 128 bits are, in a task and over tasks."""
    rows = np.array([[7, 5, 1, 10, 0, 3, 0, 3], [7, 5, 2, 11, 0, 4, 1, 4], [7, 5, 1, 12, 0, 5, 2, 5], [8, 5, 1, 13, 0, 6, 3, 6]])
    names = suffixes.ROW.names

    def by_kind(batches):
        out = [dict(zip(names, r)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        return {k: sorted(r["doc"] for r in out if r["kind"] == k) for k in (0, 1, 2)}

    assert by_kind(suffixes._combined(rows)) == {0: [10, 11, 13], 1: [12], 2: []}
    alone = [b for r in rows for b in suffixes._combined(r[None, :])]
    table = pa.Table.from_batches(alone).sort_by([(c, "ascending") for c in ("h", "ctx", "ctx2", "doc")])
    for size in (1, 2, 9):
        assert by_kind(suffixes._contexts(iter(table.to_batches(max_chunksize=size)))) == {0: [], 1: [12], 2: [10, 11]}


def test_digests_take_in_contexts_and_lengths():
    raw = b"abcabcabc"
    a, b, q = np.array([0, 3, 0, 0, 1]), np.array([3, 6, 3, 4, 4]), np.array([1, 4, 2, 1, 1])
    found = [tuple(r) for r in suffixes.context_digests(raw, a, b, q)]
    assert found[0] == found[1] and len(set(found)) == 4

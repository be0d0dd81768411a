"""Periodic runs against trying every period at every place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import periodic
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(x: list, least: int = 24, times: int = 3) -> list[tuple]:
    n, found = len(x), {}
    ids = np.unique(np.array(x, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0)
    for p in range(1, n // times + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-p] == ids[p:], [False]]).astype(int)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e + p - s >= max(least, times * p):
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def periodic_words(rng) -> list[int]:
    out = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 14))]
        out += (unit * rng.randint(1, 9))[: rng.randint(5, 90)]
    return out


def test_runs_by_brute_force():
    rng, found = random.Random(3), 0
    for _ in range(1500):
        x = periodic_words(rng)
        want = brute_force(x)
        found += len(want)
        assert periodic.find_runs(x) == want
    assert found > 1000


def test_runs_of_many_texts_through_the_sieve():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[str(v) for v in periodic_words(rng)] if rng.random() < 0.8 else [] for _ in range(6)]
        got = periodic.runs_of([[w.encode() for w in t] for t in texts], 24, 3)
        assert got == [brute_force(t) for t in texts]


def test_longer_limits():
    rng = random.Random(9)
    for _ in range(300):
        x = periodic_words(rng)
        assert periodic.find_runs(x, 30, 4) == brute_force(x, 30, 4)
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, least=20)


def test_nested_and_touching_runs():
    inner = list("ab") * 12
    x = (inner + ["c"]) * 3  # three short runs inside one long run
    got = periodic.find_runs([ord(c) for c in x])
    assert got == [(0, 24, 2), (0, 75, 25), (25, 24, 2), (50, 24, 2)]
    assert periodic.collapse(list(range(75)), got) == [0, 1, 24]


def collapsed(words: list, runs: list) -> list:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_frame_of_odd_documents(odd_docs):
    got = sorted(periodic.periodic_runs(odd_docs).collect(), key=str)
    want = []
    for r in odd_docs.collect():
        words = WORD.findall(r["text"] or "")
        runs = brute_force(words) if len(words) < 10_000 else [(0, 120_000, 977)]
        want.append((r["doc_id"], len(words), runs, " ".join(collapsed(words, runs))))
    shown = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    assert sorted(shown, key=str) == sorted(want, key=str)


def planted(doc_id, text) -> list[str]:
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_over_a_whole_table(spark, documents):
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic.op13_periodic_runs(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    some = 0
    for r in documents.collect():
        words = planted(r["doc_id"], r["text"])
        runs = brute_force(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        some += bool(runs)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(collapsed(words, runs))))
        assert got.pop(r["doc_id"]) == want
    assert not got and some > 5


def test_periods_are_written_by_doc_id(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 60))) for i in range(300)] + [(None, "a b c"), (7, None), (10, "x\ty\x0bz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], tuple(WORD.findall(r["text"]))) for r in periodic.with_periods(docs).collect() if r["doc_id"] is not None)
    assert got == sorted((i, tuple(planted(i, t))) for i, t in rows if i is not None)


def test_empty_table(no_docs):
    assert periodic.periodic_runs(no_docs).collect() == []

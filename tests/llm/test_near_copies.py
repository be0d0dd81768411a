from __future__ import annotations

import numpy as np

import corpus_pipeline
from tessera.llm import near_copies, simhash
from tests.llm.conftest import SCHEMA, SF


def words_of(text):
    words = (text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def kept_by_hand(texts: dict) -> list:
    """The smallest id of each component of pairs at Jaccard 0.8 or more."""
    root, sets = {i: i for i in texts}, {i: words_of(t) for i, t in texts.items()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in texts})


def planted(n: int = 40) -> dict:
    """Texts of 3 to 400 words with copies in which some words are new, or cut; all share one line."""
    rng, found = np.random.default_rng(5), []
    for k in range(n):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(3, 400)))] + "a line that all of the texts share with each other".split()
        for c in range(int(rng.integers(1, 6)) if k else 60):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + max(1, len(copy) // 30)))):
                copy[at] = f"new{k}-{c}-{at}"
            found.append(" ".join(copy[: len(copy) - int(rng.integers(0, 3))]))
    return {int(i): t for i, t in zip(rng.permutation(len(found)), found)}


def test_planted_near_copies_go(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), 1.0, "x") for i, t in texts.items()], SCHEMA).repartition(3)
    want = kept_by_hand(texts)
    assert len(want) < len(texts) - 60
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == want


def test_near_copies_of_test_data_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.limit(400).collect()}
    kept = corpus_pipeline.drop_near_copies(spark, docs.filter(docs.doc_id.isin(list(texts))), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == kept_by_hand(texts)


def test_odd_rows(odd_docs, no_docs):
    kept = near_copies.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3, 6, 7, 8, 9]
    assert near_copies.deduplicate(no_docs).collect() == []


def test_hashes_are_of_the_shingles():
    import xxhash

    for text in ("", "a", "A b  c", " ".join(f"é{k}" for k in range(300))):
        want = {xxhash.xxh64_intdigest(s, 42) for s in near_copies.shingle_set(text)}
        assert near_copies.shingle_hashes(text).tolist() == sorted(want)


def test_sketches_never_part_near_copies():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 256, 257, 900, 5000, 30_000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for share in (0.0, 0.05, 0.11, 0.3, 1.0):
            other = np.unique(np.append(h[int(share * len(h)) :], rng.integers(0, 1 << 63, int(share * len(h)), dtype=np.uint64)))
            x, y = near_copies.sketch_of(h), near_copies.sketch_of(other)
            both = len(np.intersect1d(h, other))
            near = 5 * both >= 4 * (len(h) + len(other) - both)
            assert near_copies.may_be_near(x, y, len(h) + len(other)) or not near
            if share > 0.2 and 40 <= n <= 5000:
                assert not near_copies.may_be_near(x, y, len(h) + len(other))


def test_blocks_of_any_chunks_give_the_same(spark, monkeypatch):
    texts = planted(12)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), 1.0, "x") for i, t in texts.items()], SCHEMA).repartition(3)
    monkeypatch.setattr(near_copies, "CHUNK_ROWS", 7)
    assert sorted(r["doc_id"] for r in near_copies.deduplicate(docs).collect()) == kept_by_hand(texts)


def test_texts_that_fingerprints_link_go(spark):
    """Fingerprints count each repetition, sets of shingles don't: texts of one frequent line are linked by op8's rule alone."""
    line = "a line that fills most of the text and comes again " * 60
    texts = {3: line + " ".join(f"u{k}" for k in range(40)), 5: line + " ".join(f"v{k}" for k in range(40)), 7: "quite another text of some more words"}
    assert kept_by_hand(texts) == [3, 5, 7]
    x, y, z = simhash.fingerprints(list(texts.values()))
    assert (int(x) ^ int(y)).bit_count() <= simhash.RADIUS < (int(x) ^ int(z)).bit_count()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), 1.0, "x") for i, t in texts.items()], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [3, 7]

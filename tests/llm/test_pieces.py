"""SentencePiece BPE against the library itself."""

from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from tessera.llm import pieces
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.model_path())


def texts(library) -> list[str]:
    rng = random.Random(5)
    odd = ["", " ", "  ", " a", "\n a", "▁a", " " * 300, "ab" * 500, "a" * 3000, "日本語 漢字\x00 é�", "🎉🎉", "　a", "<s> <0x41> </s>", "tab\there \r\n"]
    own = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.vocab_size())]
    joined = ["".join(rng.choice(own) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    stuck = ["".join(rng.choice(own).strip() for _ in range(rng.randint(50, 200))) for _ in range(40)]
    drawn = ["".join(rng.choice("abcdeinorst ▁ \nÉ日1.,") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    return odd + joined + stuck + drawn


@pytest.mark.parametrize("rounds", [200, 2])  # with two, nearly all words go on in the heap
def test_encodes_as_the_library(library, monkeypatch, rounds):
    monkeypatch.setattr(pieces, "ROUNDS", rounds)
    own, given = pieces.Model(pieces.model_path()), texts(library)
    got = [x.tolist() for a, b in pieces.slices(given) for x in own.encode(given[a:b])]
    assert got == library.encode(given)
    assert [own.decode(x) for x in got] == library.decode(got)


def test_few_kept_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 40)
    own, given = pieces.Model(pieces.model_path()), texts(library)
    assert [own.encode([t])[0].tolist() for t in given] == library.encode(given)


def test_decodes_any_ids_as_the_library(library, model):
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(262)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_merge_that_makes_a_better_pair_goes_first():
    """A joint piece may rank before the pair that made it: then the word's later places wait."""

    class Toy(pieces.Model):
        def __init__(self, ranks):
            self.size = self.base = 10
            import numpy as np

            pairs = sorted((a * 10 + b, r, i) for (a, b), (r, i) in ranks.items())
            self.keys = np.array([*(k for k, _, _ in pairs), np.iinfo(np.int64).max])
            self.ranks = np.array([*(r for _, r, _ in pairs), pieces.NO_PAIR], np.int32)
            self.joint = np.array([*(i for _, _, i in pairs), -1])
            self.pair = {k: (r, i) for k, r, i in pairs}

    import numpy as np

    toy = Toy({(0, 1): (5, 2), (2, 0): (3, 3), (3, 1): (7, 4), (0, 0): (5, 5)})
    rng = random.Random(7)
    for _ in range(500):
        words = [[rng.randint(0, 1) for _ in range(rng.randint(1, 12))] for _ in range(5)]
        flat, number = np.array(sum(words, []), np.int64), np.repeat(np.arange(5), [len(w) for w in words])
        merged, word = toy.merge(flat, number)
        assert [merged[word == k].tolist() for k in range(5)] == [toy.merge_by_heap(list(w)) for w in words]


def test_frames_hold_ids_and_texts(odd_docs, library):
    want = sorted(((r["doc_id"], library.encode(r["text"] or "")) for r in odd_docs.collect()), key=str)
    encoded = pieces.encode(odd_docs)
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=str) == want
    decoded = sorted(((r["doc_id"], r["text"]) for r in pieces.decode(encoded).collect()), key=str)
    assert decoded == sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=str)


def test_query_over_a_whole_table(spark, documents, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.op11_sentencepiece(spark, SF).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in documents.collect():
        ids = library.encode(r["text"] or "")
        assert got.pop(r["doc_id"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert not got


def test_empty_table(no_docs):
    assert pieces.encode(no_docs).collect() == pieces.round_trip(no_docs).collect() == pieces.decode(pieces.encode(no_docs)).collect() == []

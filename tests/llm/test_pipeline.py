from __future__ import annotations

import re

import pytest

import corpus_pipeline
from tessera.llm import mixing
from tessera.llm.common import durable
from tests.llm.conftest import SF
from tests.llm.test_near_copies import kept_by_hand
from tests.llm.test_operators import check_packing


@pytest.fixture(scope="module")
def stages(spark, documents):
    """The rows that each stage reads, and the last stage's result."""
    found, docs = [documents.collect()], documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = durable(stage(spark, docs, SF), f"test-stage-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
        found.append(docs.collect())
    return found


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_language_rejects_only_texts_without_letters(stages):
    assert ids(stages[1]) == ids(r for r in stages[0] if r["text"] and re.search(r"[^\W\d_]", r["text"]))


def test_exact_copies_go(stages):
    best = {}
    for r in stages[1]:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert ids(stages[2]) == sorted(best.values())


def test_one_of_each_near_group_stays(stages):
    """Five words and a similarity of 0.8, by brute force."""
    assert ids(stages[3]) == kept_by_hand({r["doc_id"]: r["text"] for r in stages[2]})


def test_mix_repeats_rows(spark, stages):
    want = {r["doc_id"]: r["reps"] for r in mixing.mix(spark.createDataFrame(stages[3])).collect()}
    got = {}
    for r in stages[4]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_every_row_is_packed(stages):
    check_packing(stages[5])
    assert ids(r for r in stages[5] if r["piece"] == 0) == ids(stages[4])


def test_run_equals_its_stages(spark, stages):
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(stages[5])

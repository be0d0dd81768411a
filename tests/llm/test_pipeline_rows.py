"""Every pipeline stage on an empty table and on odd rows with columns under the operators' own names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SF

CLASHES = ["size", "reps", "salt", "spot", "key", "node", "fp", "sketch", "digest"]


def clashing(docs):
    """docs with more columns, of names that operators use inside."""
    return docs.drop("size", "digest").withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=lambda x: x if isinstance(x, str) else "")
def test_stage_on_an_empty_table(spark, no_docs, name, stage):
    out = stage(spark, clashing(no_docs), SF)
    assert out.collect() == []


def test_stages_on_odd_rows(spark, odd_docs):
    """Rejected texts go, one of each group of copies stays, and columns pass unchanged up to packing."""
    docs = clashing(odd_docs)
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(sorted({r["doc_id"] for r in docs.select("doc_id").collect()}, key=str))
        assert docs.filter(" OR ".join(f"{c} <> 'own {c}'" for c in CLASHES)).count() == 0
    known, exact, near, mixed = kept
    assert not {3, 4, 5, 6} & set(known)  # null, empty, blank and letterless texts
    assert {1, 2, 10} <= set(known) and {1, 2, 10} & set(exact) == {10} and set(near) <= set(exact) and set(mixed) <= set(near)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(mixed) and all(1 <= r["length"] <= 1024 for r in pieces)

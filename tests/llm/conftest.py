from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}é" for i in range(120_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away.", "en", "a", 1, 1.0, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away.", "en", "a", 2, None, None),
    (3, None, None, None, None, 2.0, "y"),
    (4, "", "de", "b", 0, 3.0, ""),
    (5, "  \n\t ", "de", "b", 5, 3.0, "z"),
    (6, "1234 !!", "fr", "c", 7, 3.0, "z"),
    (7, "Released under the MIT License. Übung macht den Meister", "de", "c", 40, 3.0, "z"),
    (8, LONG, "fr", "a", len(LONG), 3.0, "z"),
    (9, "A\x0bb\x0cC d e  f", "en", None, 9, 0.0, "q"),
    (10, "The quick brown fox jumps over the lazy dog and runs far away.", "en", "b", 3, None, None),
]
#: Columns beside those of documents, under names that operators use for their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size double, digest string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, letterless and long texts, copies; a null doc_id; a row that repeats."""
    rows = [*ROWS, (None, "no id at all, yet words", "en", "a", 1, 1.0, "x"), ROWS[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con

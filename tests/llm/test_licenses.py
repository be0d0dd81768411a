from __future__ import annotations

import textwrap

import duckdb
import pandas as pd

from tessera.llm import licenses
from tessera.llm.license_texts import TEXTS
from tests.compare import normal_rows


def as_comment(text: str) -> str:
    return "/*\n" + "\n".join(" * " + line for line in textwrap.wrap(text, 70)) + "\n */\nint main() { return 0; }\n"


def edited(text: str, every: int) -> str:
    return " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def test_whole_licences_are_found_as_sql_finds_them(spark):
    rows, want = [], set()
    for n, (name, text) in enumerate(sorted(TEXTS.items())):
        head = "Copyright 2020 Someone\n" + "filler words before it " * n
        rows += [
            (10 * n, as_comment(head + text)),  # wrapped, with marks at line starts
            (10 * n + 1, head + text.upper() + " and more " * 40),
            (10 * n + 2, head + " ".join(text.split()[: len(text.split()) // 2])),  # half a licence
            (10 * n + 3, edited(text, 60)),  # a word in sixty changed
            (10 * n + 4, edited(text, 4)),  # no shingle left
            (10 * n + 5, f"{text}\n\n{text}"),
        ]
        want |= {(10 * n + k, name) for k in (0, 1, 3, 5)}
    want |= {(10 * sorted(TEXTS).index("bsd-3-clause-text") + k, "bsd-2-clause-text") for k in (0, 1, 3, 5)}  # which it includes but for the seam
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license_id", "containment", "n_windows", "first_word")
    found = [tuple(r) for r in got.collect()]
    whole = {(r[0], r[1]): r[2] for r in found if r[1] in TEXTS}
    assert whole.keys() == want
    assert all(share == 1.0 for (doc, name), share in whole.items() if doc % 10 in (0, 1, 5) and sorted(TEXTS)[doc // 10] == name)
    assert all(0.6 < share < 1.0 for (doc, _), share in whole.items() if doc % 10 == 3)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    sql = con.execute(licenses.SQL["op4_license_scan"])
    names = [d[0] for d in sql.description]
    assert normal_rows(got.columns, found) == normal_rows(names, sql.fetchall())


def test_containment_is_of_the_whole_template(spark):
    """Nine of ten parts, one of them in part."""
    body = [f"clause{k}" for k in range(28 * 10 + 4)]
    cut = body[: 28 * 9 + 4]
    cut[3] = "changed"
    (row,) = licenses.scan(spark.createDataFrame([(1, " ".join(cut))], "doc_id long, text string"), {"long": " ".join(body)}).collect()
    assert (row["containment"], row["first_word"]) == ((28 * 9 - 4) / 280, 0)

"""License scans: MinHash retrieval over text windows, verified by exact shingle containment
(DataFrame operations only).

A text is its lower-cased runs of letters and digits. Windows of ``WINDOW`` words begin every
``STEP`` words, so a notice of up to STEP words lies whole in one. Only word shingles that
some template has can count towards its containment, so windows are reduced to those: that
leaves intersections as they are and raises Jaccard similarity. Each band is one MinHash, so a
window at similarity s to a template is retrieved with probability 1 - (1 - s)^bands. The
lowest s at which a window holds ``CONTAINMENT`` of a template follows from the template's
number of shingles and from how many a window can have; the number of bands is what makes the
probability of a miss at most ``MISS`` for every template even there (411 for a template of one
shingle in a window full of others). Retrieved pairs are kept where the window has at least
``CONTAINMENT`` of the template's shingles, compared as text.

Templates are a parameter, at most ``MOST_TEMPLATE_WORDS`` words in all (checked): what is
joined by broadcast has that bound. Templates longer than STEP words are cut into parts of
that length; a template is found where at least ``CONTAINMENT`` of its parts are, and the
reported containment is that of the whole template: shingles held in parts that were found, of
all it has. The templates are notices (``NOTICES``) and whole licences (``license_texts``); a
text is reported for each that it holds, so for a licence's notice as well as for the licence.

Behaviour: null and empty texts, and ones of fewer than five words, match nothing. A result
row is one (document, template); rows that repeat a doc_id and text count once, unequal texts
under one doc_id are scanned apart. Null doc_ids are reported as null. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty
from tessera.llm.license_texts import TEXTS

#: Notices as their licences word them.
NOTICES = {
    "agpl-3.0": "This program is distributed under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
TEMPLATES = NOTICES | TEXTS

SHINGLE, WINDOW, STEP, CONTAINMENT = 5, 64, 32, 0.8
#: Probability that no band retrieves a template that a window holds, at most.
MISS = 0.001
MOST_TEMPLATE_WORDS = 100_000


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_shingles(templates: Mapping[str, str], shingle: int = SHINGLE) -> list[tuple[str, int, list[str]]]:
    """(template, part, distinct shingles); parts have STEP words at most and overlap so that no shingle is lost."""
    if sum(len(_words(t)) for t in templates.values()) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words")
    parts = []
    for name, text in sorted(templates.items()):
        words = _words(text)
        if len(words) < shingle:
            raise ValueError(f"template {name} has fewer than {shingle} words")
        for k, a in enumerate(range(0, max(len(words) - shingle + 1, 1), STEP - shingle + 1)):
            own = words[a : a + STEP]
            parts.append((name, k, sorted({" ".join(own[i : i + shingle]) for i in range(len(own) - shingle + 1)})))
    return parts


def bands_for(sizes: Iterable[int], shingle: int = SHINGLE, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands of one MinHash that miss a held template of any of these numbers of shingles with at most this probability."""
    most = WINDOW - shingle + 1
    least = min(math.ceil(containment * m) / (most + m - math.ceil(containment * m)) for m in sizes)
    return math.ceil(math.log(miss) / math.log1p(-least))


def _minhashes(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(b, s))))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license_id, containment, n_windows, first_word: a row for each template that a document holds."""
    spark = docs.sparkSession
    parts = template_shingles(templates, shingle)
    known = spark.createDataFrame(parts, "license_id string, part int, wanted array<string>")
    ends = [sorted({s.split(" ")[k] for _, _, shingles in parts for s in shingles}) for k in (0, -1)]

    words = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_key"), F.regexp_extract_all(F.lower(text_or_empty()), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    positions = F.sequence(F.lit(0), F.size("words") - shingle)
    at = F.filter(positions, lambda i: F.get(F.col("words"), i).isin(ends[0]) & F.get(F.col("words"), i + shingle - 1).isin(ends[1]))  # as some template's shingle does
    found = F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, shingle), " ").alias("shingle")))
    cut = words.filter(F.size("words") >= shingle).select("doc_id", "text_key", F.inline(found))
    vocabulary = known.select(F.explode("wanted").alias("shingle")).distinct()
    hits = cut.join(F.broadcast(vocabulary), "shingle", "left_semi")

    last = F.floor(F.col("at") / STEP).cast("int")
    window = ["doc_id", "text_key", "window"]  # dealt by a stated number: windows are few bytes and much MinHash, which adaptive execution would put in one task
    windows = (
        hits.select("doc_id", "text_key", "at", "shingle", F.explode(F.array(last, last - 1)).alias("window"))
        .filter((F.col("window") >= 0) & (F.col("at") + shingle <= F.col("window") * STEP + WINDOW))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *window)
        .groupBy(*window)
        .agg(F.array_sort(F.collect_set("shingle")).alias("has"))
    )
    n = bands_for((len(shingles) for _, _, shingles in parts), shingle, containment)
    bands = known.select("license_id", "part", "wanted", F.posexplode(_minhashes(F.col("wanted"), n)).alias("band", "value"))
    retrieved = (
        windows.select("*", F.posexplode(_minhashes(F.col("has"), n)).alias("band", "value"))
        .join(F.broadcast(bands), ["band", "value"])
        .dropDuplicates([*window, "license_id", "part"])
    )
    held = F.size(F.array_intersect("has", "wanted"))
    verified = retrieved.withColumn("held", held).filter(F.col("held") / F.size("wanted") >= containment)
    per_part = verified.groupBy("doc_id", "text_key", "license_id", "part").agg(F.max("held").alias("held"), F.count(F.lit(1)).alias("n_windows"), F.min("window").alias("window"))
    whole = known.groupBy("license_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.size("wanted")).alias("n_shingles"))
    return (
        per_part.groupBy("doc_id", "text_key", "license_id")
        .agg(F.sum("held").alias("held"), F.sum("n_windows").alias("n_windows"), F.min("window").alias("window"), F.count(F.lit(1)).alias("parts"))
        .join(F.broadcast(whole), "license_id")
        .filter(F.col("parts") / F.col("n_parts") >= containment)
        .select("doc_id", "license_id", (F.col("held") / F.col("n_shingles")).alias("containment"), "n_windows", (F.col("window") * STEP).cast("long").alias("first_word"))
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"('{name}', {part}, '{s}')" for name, part, shingles in template_shingles(TEMPLATES) for s in shingles)
    return f"""
WITH known(license_id, part, shingle) AS (VALUES {rows}),
sizes AS (
  SELECT license_id, part, count(*) AS n FROM known GROUP BY 1, 2),
wholes AS (
  SELECT license_id, count(*) AS n_parts, sum(n) AS n_shingles FROM sizes GROUP BY 1),
words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
places AS (
  SELECT doc_id, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS pos FROM words WHERE len(w) >= {SHINGLE}),
hits AS (
  SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {SHINGLE}], ' ') AS shingle FROM places),
spread AS (
  SELECT doc_id, shingle, unnest([pos // {STEP}, pos // {STEP} - 1]) AS win, pos FROM hits WHERE shingle IN (SELECT shingle FROM known)),
windows AS (
  SELECT s.doc_id, k.license_id, k.part, s.win, count(DISTINCT k.shingle) AS held
  FROM spread s JOIN known k USING (shingle)
  WHERE s.win >= 0 AND s.pos + {SHINGLE} <= s.win * {STEP} + {WINDOW}
  GROUP BY 1, 2, 3, 4),
parts AS (
  SELECT doc_id, license_id, part, max(held) AS held, count(*) AS n_windows, min(win) AS win
  FROM windows JOIN sizes USING (license_id, part) WHERE held / n >= {CONTAINMENT} GROUP BY 1, 2, 3)
SELECT doc_id, license_id, (sum(held) / any_value(n_shingles))::DOUBLE AS containment, sum(n_windows)::BIGINT AS n_windows, (min(win) * {STEP})::BIGINT AS first_word
FROM parts JOIN wholes USING (license_id) GROUP BY 1, 2 HAVING count(*) / any_value(n_parts) >= {CONTAINMENT}"""


SQL = {"op4_license_scan": _sql()}

"""Registration of queries with their SQL, and the tables that queries see.

A query is a function of ``Tables``. Its SQL may name any domain view of ``tessera.sources.adapters``;
the views that it names are put in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver tables and domain views of one directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in adapters.VIEWS:
            return adapters.VIEWS[name](self)
        if name in adapters.TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """sql with the domain views that it names, directly or through others, as common table expressions."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z_]+\b", text):
            if name in adapters.VIEW_SQL and name not in used:
                need(adapters.VIEW_SQL[name])
                if name not in used:
                    used.append(name)

    need(sql)
    if not used:
        return sql
    views = ",\n".join(f"{name} AS ({adapters.VIEW_SQL[name].strip()})" for name in used)
    body = sql.strip()
    recursive = re.match(r"WITH RECURSIVE\b", body)
    body = re.sub(r"^WITH( RECURSIVE)?\b", ",", body) if body.startswith("WITH") else body
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}\n{body}"


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return build

    return register

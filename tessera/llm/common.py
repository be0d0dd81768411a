"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_base

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch at most: whole texts and lists of sketches are large.
BATCH_ROWS, BATCH_CONF = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"

_ROOT: dict[str, str] = {}
#: Paths of the tables that durable returned, by the frame's identity.
_PATHS: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session under the shared one, removed when the session's process ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOT:
        _ROOT[app] = f"{shared_base(spark)}/tessera-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _ROOT[app])
    return _ROOT[app]


def _drop(spark: SparkSession, folder: str) -> None:
    """Remove a written table, or all of them, where the session still lives."""
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand Python at most BATCH_ROWS rows at once; the session's own setting returns after them."""
    before = spark.conf.get(BATCH_CONF)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that durable wrote and nothing reads any more."""
    for df in tables:
        _drop(df.sparkSession, _PATHS.pop(id(df)))

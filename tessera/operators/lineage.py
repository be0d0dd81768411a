"""Cutting lineage in iterative jobs, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder on a local master; elsewhere executors would not share it, so that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return _LOCAL[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, and lineage ends there. Removed when the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

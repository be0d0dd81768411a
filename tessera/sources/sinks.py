"""Sinks: exports as files, and the DataFrames that they hold."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.contact import is_placeholder
from tessera.operators.lineage import shared_base


def contact_export(contacts: DataFrame) -> DataFrame:
    """Contacts for a mailing list: no placeholders, checked ones first when written."""
    shown = contacts.filter(F.col("email").isNull() | ~is_placeholder())
    return shown.withColumn("email", F.coalesce("email", F.lit("")))


def write_contact_csv(contacts: DataFrame, path: str) -> None:
    contact_export(contacts).orderBy(F.desc("user_verified"), "id").write.mode("overwrite").csv(path, header=True)


def report_index(reports: DataFrame) -> DataFrame:
    """Each company's reports by id, with character counts."""
    entry = F.struct("id", "report_type", "rcept_dt", "n_chars")
    return reports.groupBy("corp_code").agg(F.array_sort(F.collect_list(entry)).alias("reports"), F.sum("n_chars").alias("chars"))


def write_index_json(reports: DataFrame, path: str) -> None:
    report_index(reports).write.mode("overwrite").json(path)


def write_text_tree(docs: DataFrame, path: str, by: list[str], text: str = "text") -> None:
    """One folder for each value of the by columns, with text files in it."""
    docs.select(*by, F.col(text).alias("value")).repartition(*by).write.mode("overwrite").partitionBy(*by).text(path)


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_table(df: DataFrame, path: str) -> None:
    """A rebuilt table: all rows replaced."""
    df.write.mode("overwrite").parquet(path)


def round_trip(df: DataFrame, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """df through a sink and back, by way of the shared folder."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/sink-{uuid.uuid4().hex}"
    write(df, path)
    return read(spark, path)

"""Readers and writers of the stages' files. Schemas are always given, never inferred."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.schemas import CORPUS, PUBLICATIONS, QAC


def with_order(pubs: DataFrame) -> DataFrame:
    """pubs with ord, their place by date and number, both descending: "first" means this order from here on.

    Ranges of dates are ordered one by one; no task sorts all rows.
    """
    days = pubs.groupBy("publication_date").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.desc("publication_date")).rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(F.col("publication_date").alias("_day"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("publication_date").orderBy(F.desc("publication_number"))
    rows = pubs.withColumn("_place", F.row_number().over(within)).join(starts, F.expr("publication_date <=> _day"))
    return rows.withColumn("ord", F.col("_start") + F.col("_place")).drop("_day", "_start", "_place")


def read_publications(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """A dump of publications as NDJSON (a bad line ends the run) or Parquet, or a warehouse table or query by the BigQuery
    connector, if the session has it."""
    if form == "bigquery":
        return spark.read.format("bigquery").load(path).select(PUBLICATIONS.fieldNames())
    if form == "parquet":
        return spark.read.schema(PUBLICATIONS).parquet(path)
    return spark.read.schema(PUBLICATIONS).option("mode", "FAILFAST").json(path)


def write_publications(pubs: DataFrame, path: str, form: str = "json") -> None:
    pubs.write.mode("overwrite").format(form).save(path)


def _read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="FAILFAST").csv(path)
    return rows.fillna("")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, CORPUS)


def read_qac(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, QAC)


def dense_index(rows: DataFrame, name: str = "i") -> DataFrame:
    """rows, as a reader gives them, with their place from 0 in the order of files and of lines in a file.

    Only a count for each part of a file is gathered, so no task sees all rows.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    parts = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(parts, ["_file", "_block"]).select(*rows.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias(name))


def credential(spark: SparkSession, name: str) -> str:
    """A key from the session's conf (corpusforge.<name>) or the driver's environment; raises before any task runs."""
    if found := spark.conf.get(f"corpusforge.{name}", None) or os.environ.get(name):
        return found
    raise ValueError(f"set {name} in the environment, or corpusforge.{name} in the session's conf")


def write_csv(rows: DataFrame, path: str) -> None:
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    rows.write.mode("overwrite").options(**options).csv(path)


def write_by_language(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").partitionBy("language").parquet(path)

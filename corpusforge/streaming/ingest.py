"""Incremental intake: new files of publications as a stream, cleaned and gated row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from corpusforge.operators.corpus import by_language, cleaned, gated
from corpusforge.schemas import MIN_WORDS, PUBLICATIONS


def read_new_publications(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(StructType([*PUBLICATIONS.fields, StructField("ord", LongType())])).json(path)


def write_new_rows(pubs: DataFrame, path: str, checkpoint: str, least_words: int = MIN_WORDS) -> StreamingQuery:
    """Appends the rows of all files that are there now, then stops; a restart goes on where it stopped."""
    rows = gated(cleaned(by_language(pubs)), least_words).select("ord", "language", "publication_number", "title", "abstract")
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy("language").trigger(availableNow=True).start()

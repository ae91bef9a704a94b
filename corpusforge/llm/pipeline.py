"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

language_id  drops documents whose language can't be told.
line_dedup   drops lines that an earlier document has, and documents that had text but have none left.
simhash      keeps one document of each group of near duplicates (five-word shingles, similarity 0.8 or more).
mixing       takes documents, whole and up to twice, until each source has its target; range-sorted by position.
byte_bpe     encodes every text: the documents' columns but text, n_tokens, ids (binary, little-endian unsigned 32-bit).

Each stage works on all rows of its input and takes an empty one. Columns that it doesn't name stay as they are, whatever
their names, but for a column lines_dropped, and in the last stage n_tokens and ids. A stage removes the scratch tables of
the one before it, whose result is written by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe, language_id, line_dedup, mixing, simhash
from corpusforge.llm.common import BLANKS, clear_scratch, save, scratch_scope, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch_scope("pipeline") as scope:
            clear_scratch(spark, scope)
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go; repeated rows stay or go together."""
    return language_id.keep_identified(docs)


@_stage
def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay; n_chars is that of the text that is left. Of equal ids with equal texts all rows are
    one document; a null id comes last."""
    cleaned = line_dedup.without_recurring_lines(docs)
    emptied = (F.col("lines_dropped") > 0) & (F.btrim("text", F.lit(BLANKS)) == "")
    return cleaned.filter(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group stays, with all rows that have it; rows with a null id stay. Wordless texts, null and
    empty ones included, are one group."""
    return simhash.keep_one(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and wordless texts are never taken; a null source is a source; repeated rows are taken like others."""
    return mixing.mix(docs)


@_stage
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null or empty text has no tokens; every row gives a row."""
    return bpe.encode_rows(docs, bpe.public_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL can express neither the network nor the pre-tokenizer's pattern; tests/llm compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        # The tables of a stage are removed as soon as the next stage's result is written.
        with scratch_scope(f"stage-{name}") as scope:
            docs = save(stage(spark, docs, sf_dir), "documents")
        if before:
            clear_scratch(spark, before)
        before = scope
    return docs

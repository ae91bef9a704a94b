"""Reproducible samples: rows in the order of a seeded hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import strip
from corpusforge.schemas import GENERATION_CHARS


def order_hash(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def uniform_sample(rows: DataFrame, size: int, seed: int = 42, key: str = "id") -> DataFrame:
    return rows.withColumn("_h", order_hash(seed, key)).orderBy("_h", key).limit(size).drop("_h")


def stratified_sample(rows: DataFrame, size: int, seed: int = 42, key: str = "id", language: str = "language") -> DataFrame:
    """max(1, round(size * share)) rows of each language (half to even), then at most size in all; never filled up.

    Only the strata's counts are gathered ahead; they join as a table with a row for each language.
    """
    counts = rows.groupBy(language).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    quotas = counts.crossJoin(F.broadcast(total)).select(  # one row of totals
        F.col(language).alias("_language"),
        F.col("_total"),
        F.least("_n", F.greatest(F.lit(1), F.bround(F.lit(size) * F.col("_n") / F.col("_total"), 0).cast("long"))).alias("_k"),
    )
    order = Window.partitionBy(language).orderBy("_h", key)
    ranked = rows.withColumn("_h", order_hash(seed, key)).withColumn("_place", F.row_number().over(order))
    # No stratum gives more than size rows: a constant bound that Spark applies before the shuffle.
    ranked = ranked.filter(F.col("_place") <= size).join(F.broadcast(quotas), F.col(language).eqNullSafe(F.col("_language")))
    chosen = ranked.filter((F.col("_place") <= F.col("_k")) | (F.col("_total") <= size))
    return chosen.orderBy("_h", key).limit(size).drop("_h", "_place", "_language", "_total", "_k")


def sampled_context(rows: DataFrame, characters: int = GENERATION_CHARS) -> DataFrame:
    """id, context: the prompt's context, or the title if that is empty; blank ones go."""
    text = F.when(F.coalesce("context", F.lit("")) == "", F.col("title")).otherwise(F.col("context"))
    return rows.withColumn("context", F.left(text, F.lit(characters))).filter(strip(F.col("context")) != "").select("id", "context")

"""Retrieval benchmark tables and flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import strip


def mteb_corpus(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("id").alias("_id"), "title", F.col("context").alias("text"))


def identified(qac: DataFrame, corpus: DataFrame) -> DataFrame:
    """qac (with i, its place from 0) and query_id: corpus id and language, or place and language for ids that the
    corpus lacks; a repeated one gets the place added."""
    known = corpus.select(F.col("id").alias("corpus_id")).distinct().withColumn("_known", F.lit(True))
    rows = qac.join(known, "corpus_id", "left")
    own = F.concat(F.col("corpus_id"), F.lit("_q_"), F.col("language"))
    base = F.when(F.col("_known"), own).otherwise(F.concat(F.lit("q_"), F.col("i").cast("string"), F.lit("_"), F.col("language")))
    rows = rows.withColumn("_base", base)
    again = F.row_number().over(Window.partitionBy("_base").orderBy("i")) > 1
    query_id = F.when(again, F.concat(own, F.lit("_"), F.col("i").cast("string"))).otherwise(F.col("_base"))
    return rows.withColumn("query_id", query_id).drop("_known", "_base")


def mteb_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("query_id").alias("_id"), F.col("question").alias("text"))


def mteb_qrels(rows: DataFrame) -> DataFrame:
    """Rows whose corpus id dangles stay."""
    return rows.select(F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), F.lit(1.0).alias("score"))


def mteb_qac(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "corpus_id", "language", "question", "answer")


def corpus_metadata(corpus: DataFrame) -> DataFrame:
    """id, context, language of the last row (by ord) of each stripped id that isn't blank."""
    rows = corpus.select(strip(F.col("id")).alias("id"), strip(F.col("context")).alias("context"), strip(F.col("language")).alias("language"), "ord")
    last = F.max_by(F.struct("context", "language"), "ord").alias("m")
    return rows.filter("id <> ''").groupBy("id").agg(last).select("id", "m.*")


def flat_export(qac: DataFrame, corpus: DataFrame) -> DataFrame:
    meta = corpus_metadata(corpus).select(F.col("id").alias("_id"), F.col("context").alias("_context"), F.col("language").alias("_language"))
    rows = qac.withColumn("_key", strip(F.coalesce("corpus_id", F.lit("")))).join(meta, F.col("_key") == F.col("_id"), "left")
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    return rows.select(
        blank("question").alias("question"),
        blank("answer").alias("answer"),
        F.coalesce("_context", F.lit("")).alias("corpus"),
        blank("language").alias("question_lang"),
        F.coalesce("_language", F.lit("")).alias("source_lang"),
    )


def export_counts(flat: DataFrame) -> DataFrame:
    return flat.agg(F.count(F.lit(1)).alias("written"), F.count_if(F.col("corpus") == "").alias("missing_contexts"))


def squad(qac: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows whose answer their context has: id, context, question, answer_text, answer_start, languages."""
    docs = corpus.select(F.col("id").alias("corpus_id"), "context", F.col("language").alias("language_context"))
    rows = qac.join(docs, "corpus_id").withColumn("answer_start", F.instr("context", F.col("answer")).cast("long") - 1)
    return rows.filter((F.col("answer_start") >= 0) & (F.col("answer") != "")).select(
        "corpus_id", "context", "question", F.array(F.struct(F.col("answer").alias("text"), "answer_start")).alias("answers"),
        F.col("language").alias("language_question"), F.col("language").alias("language_answer"), "language_context",
    )


def language_pairs(qac: DataFrame, corpus: DataFrame) -> DataFrame:
    docs = corpus.select(F.col("id").alias("corpus_id"), F.col("language").alias("_language"))
    pairs = qac.join(docs, "corpus_id").select(F.concat_ws("_", "_language", "language").alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


CARD = """---
configs:
{configs}
---

## Data source and licence

Texts derive from a public patent dataset under CC BY 4.0 (https://creativecommons.org/licenses/by/4.0/); this
dataset is an adaptation and is not endorsed by the source's providers.
"""


def dataset_card(names: list[str]) -> str:
    one = "- config_name: {0}\n  data_files:\n  - split: train\n    path: data/{0}/*.parquet"
    return CARD.format(configs="\n".join(one.format(n) for n in names))


def write_package(path: str, **tables: DataFrame) -> None:
    """Each table as Parquet under path/data/<name>, and the card beside them, in any store that Spark writes to."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/data/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(dataset_card(list(tables)),)], "card string").coalesce(1).write.mode("overwrite").text(f"{path}/card")

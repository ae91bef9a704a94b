"""The test tables reshaped into the relations that the operators work on, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusforge.operators.quality import first_turns


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    rows = docs.join(after, "doc_id", "left")
    number = F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    n = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    text = lambda t, l: F.struct(t.alias("text"), l.alias("language"))  # noqa: E731, E741
    codes = lambda *c: F.array(*[F.struct(F.lit(x).cast("string").alias("code")) for x in c])
    own = text(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")))
    rows = rows.select(
        "doc_id",
        F.concat(F.lit("P"), F.lpad(number.cast("string"), 7, "0")).alias("publication_number"),
        F.col("source").alias("family_id"),
        F.upper("lang").alias("country_code"),
        (F.lit(20240101) + F.col("doc_id") % 28).cast("int").alias("publication_date"),
        F.array(text(F.substring_index("text", "\n", 1), F.col("lang"))).alias("title_localized"),
        F.when(F.col("_text").isNull(), F.array(own)).otherwise(F.array(own, text(F.col("_text"), F.col("_lang")))).alias("abstract_localized"),
        F.when(n % 3 == 0, codes("C07D")).when(n % 3 == 1, codes("G06F", "A61K")).alias("cpc"),
        F.when(n % 5 == 0, codes("A61P")).otherwise(codes(None, "H01L")).alias("ipc"),
    )
    order = Window.partitionBy("publication_date").orderBy(F.desc("publication_number"), "doc_id")
    # The date takes 28 values; a date's rows come after those of later dates.
    place = F.row_number().over(order).cast("long")
    return rows.withColumn("ord", (F.lit(20240128).cast("long") - F.col("publication_date")) * 1_000_000_000_000 + place)


PUBS_SQL = r"""
pubs AS (
  SELECT d.doc_id, 'P' || lpad(CAST(CASE WHEN d.doc_id % 10 = 9 THEN d.doc_id - 1 ELSE d.doc_id END AS VARCHAR), 7, '0') AS publication_number,
    d.source AS family_id, upper(d.lang) AS country_code, CAST(20240101 + d.doc_id % 28 AS INTEGER) AS publication_date,
    split_part(d.text, chr(10), 1) AS title, d.lang AS title_lang, d.text AS text1, lower(d.lang) AS lang1,
    CASE WHEN d.doc_id % 2 = 0 THEN upper(d.lang) ELSE d.lang END AS raw_lang1, e.text AS text2, e.lang AS lang2,
    CAST(regexp_extract(d.source, '[0-9]+') AS INTEGER) AS n
  FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1),
classes AS (
  SELECT *, CASE n % 3 WHEN 0 THEN ['C07D'] WHEN 1 THEN ['G06F', 'A61K'] END AS cpc,
    CASE WHEN n % 5 = 0 THEN ['A61P'] ELSE [NULL, 'H01L'] END AS ipc,
    row_number() OVER (ORDER BY publication_date DESC, publication_number DESC, doc_id) AS ord FROM pubs)"""


def match(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 1").select("doc_id")
    rows = publications(spark, sf_dir).join(chosen, "doc_id", "left_semi").select("publication_number")
    return rows.union(rows)


MATCH_SQL = """
match AS (
  SELECT publication_number FROM pubs JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a corpus row, its id made of number and language."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("_"), "lang").alias("id"),
        F.col("lang").alias("language"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("context"),
        F.col("doc_id").alias("ord"),
    )


CORPUS_SQL = """
corpus AS (
  SELECT 'D' || CAST(doc_id AS VARCHAR) || '_' || lang AS id, lang AS language, split_part(text, chr(10), 1) AS title, text AS context,
    doc_id AS ord FROM documents)"""


def qac(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = first_turns(read(spark, sf_dir, "conversations"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "lang")
    rows = turns.join(docs, "conv_id")
    per = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = rows.withColumn("place", place).join(starts, "conv_id")
    key = F.when(F.col("conv_id") % 7 == 3, F.concat(F.lit("missing-"), F.col("conv_id").cast("string")))
    key = key.otherwise(F.concat(F.lit("D"), F.col("conv_id").cast("string"), F.lit("_"), "lang"))
    return rows.select((F.col("start") + F.col("place")).alias("i"), key.alias("corpus_id"), F.col("lang").alias("language"), "question", "answer")


QAC_SQL = """
turns AS (
  SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qac AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i,
    CASE WHEN conv_id % 7 = 3 THEN 'missing-' || CAST(conv_id AS VARCHAR) ELSE 'D' || CAST(conv_id AS VARCHAR) || '_' || lang END AS corpus_id,
    lang AS language, question, answer
  FROM turns JOIN documents ON doc_id = conv_id WHERE role = 'user' AND next_role = 'assistant')"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of eight flags, five severities and three failure types, from a row number."""
    names = ["language_ok", "meaning_ok", "technical_ok", "specificity_ok", "terminology_ok", "artifact_ok", "fluency_ok", "grammar_ok"]
    rows = spark.range(256 * 15).withColumnRenamed("id", "k")
    flags = [(F.shiftright("k", b) % 2 == 1).alias(name) for b, name in enumerate(names)]
    rest = F.floor(F.col("k") / 256)
    severity = F.when(rest % 5 == 0, "low").when(rest % 5 == 1, "medium").when(rest % 5 == 2, " High ").when(rest % 5 == 3, "bad")
    failure = F.when(F.floor(rest / 5) == 0, "none").when(F.floor(rest / 5) == 1, "too-generic").otherwise("odd")
    return rows.select("k", *flags, severity.alias("severity"), failure.alias("failure_type"))


VERDICTS_SQL = """
verdicts AS (
  SELECT k, (k >> 0) % 2 = 1 AS language_ok, (k >> 1) % 2 = 1 AS meaning_ok, (k >> 2) % 2 = 1 AS technical_ok, (k >> 3) % 2 = 1 AS specificity_ok,
    (k >> 4) % 2 = 1 AS terminology_ok, (k >> 5) % 2 = 1 AS artifact_ok, (k >> 6) % 2 = 1 AS fluency_ok, (k >> 7) % 2 = 1 AS grammar_ok,
    CASE (k // 256) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN ' High ' WHEN 3 THEN 'bad' END AS severity,
    CASE k // 256 // 5 WHEN 0 THEN 'none' WHEN 1 THEN 'too-generic' ELSE 'odd' END AS failure_type
  FROM range(3840) t(k))"""

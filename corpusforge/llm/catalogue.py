"""Queries of this subpackage for ``__spark_entry__``: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe, exact_dedup, language_id, line_dedup, mixing, sharding, simhash, token_counts, token_files, vector_search
from corpusforge.llm import pipeline as stages
from corpusforge.llm.common import table

#: Bytes of text per shard, for training shards that a loader reads whole.
SHARD_BYTES = 1 << 20

#: Files of the public vocabulary that the token queries use.
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"

SQL: dict[str, str] = {}


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.public_path(RANKS))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_files(table(spark, sf_dir, "documents"), bpe.public_path(TOKENIZER))
    return token_files.read_documents(files)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


SQL["op3_sharding"] = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS k
  FROM documents),
hashed AS (
  SELECT doc_id, n_bytes, CAST('0x' || substr(md5(concat_ws(':', k, CAST(row_number() OVER (PARTITION BY k) - 1 AS VARCHAR))), 1, 15) AS BIGINT) AS h
  FROM keyed),
placed AS (
  SELECT doc_id, n_bytes, h, 0 AS d, sum(n_bytes) OVER () AS b, count(*) OVER () AS n FROM hashed
  UNION ALL
  SELECT doc_id, n_bytes, h, d + 1, sum(n_bytes) OVER (PARTITION BY h >> (59 - d)), count(*) OVER (PARTITION BY h >> (59 - d))
  FROM placed WHERE b > {SHARD_BYTES} AND n > 1 AND d < 60)
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(h >> (60 - d)), 60, '0'), d) END AS shard, d AS shard_depth,
       CAST(b AS BIGINT) AS shard_bytes, CAST(n AS BIGINT) AS shard_rows, b > {SHARD_BYTES} AS oversized
FROM placed WHERE b <= {SHARD_BYTES} OR n = 1 OR d = 60
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


SQL["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS code_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY code_points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2, jaccard=None)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken_in_order(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")


SQL["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
h AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS hash FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM h GROUP BY source),
w AS (
  SELECT *, CASE place WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(CASE place WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS ramp FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - 2 * coalesce(CAST(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
            / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (
  SELECT *, first_value(CASE WHEN level * weight <= 2 * source_size THEN level END IGNORE NULLS)
            OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shared FROM l),
t AS (
  SELECT source, source_size, ramp, CAST(CASE WHEN shared IS NULL THEN 2 * source_size ELSE least(shared * weight, CAST(2 * source_size AS DOUBLE)) END AS DOUBLE) AS target FROM f),
c AS (
  SELECT h.*, t.source_size, t.target, t.ramp,
         coalesce(sum(size) OVER (PARTITION BY h.source ORDER BY hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS passes
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, passes + CASE WHEN size > 0 AND before + size / 2 <= target - passes * source_size THEN 1 ELSE 0 END AS copies,
         least(1.0::DOUBLE, (before + size / 2) / target) AS share FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies,
       CASE WHEN copies > 0 THEN CASE WHEN ramp = 0 THEN share ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share) - (1 - ramp)) / (2 * ramp) END END AS first_position
FROM k
"""

def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "lines_dropped", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")
    )


SQL["op8_line_dedup"] = r"""
WITH parts AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM parts),
tokens AS (
  SELECT doc_id, i, lines[i] AS line, list_transform(string_split_regex(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+'),
         lambda t: CASE WHEN regexp_matches(t, '[0-9@]|://') THEN '<*>' ELSE t END) AS t
  FROM numbered),
templates AS (SELECT t, len(t) AS n, t[1:3] AS leading, min(doc_id) AS first FROM tokens WHERE len(t) >= 5 GROUP BY t),
alike AS (
  SELECT DISTINCT a.t FROM templates a JOIN templates b ON a.n = b.n AND a.leading = b.leading AND b.first < a.first
  WHERE list_sum(list_transform(range(1, a.n + 1), lambda i: CAST(a.t[i] = b.t[i] AS INTEGER))) >= a.n * CAST(0.8 AS DOUBLE)),
judged AS (
  SELECT k.doc_id, k.i, k.line, m.first IS NOT NULL AND (k.doc_id > m.first OR a.t IS NOT NULL) AS dropped
  FROM tokens k LEFT JOIN templates m ON k.t = m.t LEFT JOIN alike a ON k.t = a.t),
rest AS (
  SELECT doc_id, count(*) FILTER (dropped) AS lines_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS rest FROM judged GROUP BY doc_id)
SELECT doc_id, lines_dropped, CAST(strlen(CASE WHEN text IS NOT NULL THEN rest END) AS BIGINT) AS n_bytes, sha256(CASE WHEN text IS NOT NULL THEN rest END) AS text_sha256
FROM parts JOIN rest USING (doc_id)
"""


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: a replacement in its middle, an insertion at a quarter, a deletion at three quarters."""
    length = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, n, new: F.struct(F.floor(length * at).cast("int").alias("start"), F.lit(n).alias("length"), F.lit(new).alias("replacement"))
    edits = F.array(edit(0.5, 12, " revised in 2024 "), edit(0.25, 0, "\n\n(see note) "), edit(0.75, 40, ""))
    return token_counts.counts_after_edits(table(spark, sf_dir, "documents"), edits, bpe.public_path(RANKS))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_token_files,
        op3_sharding,
        op4_exact_dedup,
        op5_simhash,
        op6_mixing,
        op7_language_id,
        op8_line_dedup,
        op9_vector_search,
        op10_token_counts,
        pipeline,
    )
}

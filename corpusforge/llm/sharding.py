"""Sharding by extendible hashing; DataFrame functions only.

A bucket is a prefix of the rows' 60-bit hashes. It is a shard as soon as its bytes fit the limit; only oversized
buckets look at another bit. The directory has one entry per prefix of a common depth and names the shard that the
prefix belongs to; deeper directories exist only below entries that are still too large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import hash60, save, text_of

BITS = 60
#: Bits by which a directory goes beyond what evenly spread bytes would need, and by which a deeper one continues.
SPARE_BITS = 4
#: Levels of the directory that are summed up between two written ones.
LEVELS_TOGETHER = 4
#: Copies of one row that a single task numbers.
COPY_BLOCK = 4096


def hashed_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and hash of each row. Repeated rows are counted first and then numbered, so each copy has a
    hash of its own; numbering is dealt out in blocks, so no task holds all copies of a row."""
    content = text_of(text)
    keys = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(content).cast("long").alias("n_bytes"),
        F.concat_ws(":", F.col(doc_id).cast("string"), F.md5(content)).alias("key"),
    )
    counted = keys.groupBy("doc_id", "n_bytes", "key").agg(F.count(F.lit(1)).alias("copies"))
    blocks = counted.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPY_BLOCK})"))).hint("rebalance")
    first = F.col("block") * COPY_BLOCK
    numbered = blocks.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPY_BLOCK, F.col("copies")) - 1)))
    return numbered.select("doc_id", "n_bytes", hash60(F.concat_ws(":", "key", F.col("copy").cast("string"))).alias("hash"))


def _prefix(depth: int, column: str = "hash"):
    return F.shiftright(column, BITS - depth)


def directory(rows: DataFrame, limit: int, base: int, depth: int) -> DataFrame:
    """cell, shard_depth, prefix, shard_bytes, shard_rows for each prefix of `depth` bits that has a shard; rows are those
    whose prefixes shorter than `base` are oversized. Prefixes that are still too large have none.

    Prefixes of d bits are summed up from those of d + 1 bits, so all levels together are twice the last one. A prefix is a
    shard if it fits and the one above it doesn't.
    """
    fits = lambda c, d: (F.col(f"{c}shard_bytes") <= limit) | (F.col(f"{c}shard_rows") == 1) | F.lit(d == BITS)
    sums = [F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_rows").alias("shard_rows")]
    level = rows.groupBy(_prefix(depth).alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    level, found = save(level, "cells"), []
    for d in range(depth, base, -1):
        two = F.collect_list(F.struct("prefix", "shard_bytes", "shard_rows")).alias("parts")  # one or two prefixes
        level = level.groupBy(F.shiftright("prefix", 1).alias("prefix")).agg(*sums, two)
        if (depth - d) % LEVELS_TOGETHER == 0:
            level = save(level, "level")
        found.append(level.filter(~fits("", d - 1)).select(F.explode("parts").alias("p")).filter(fits("p.", d)).select("p.*", F.lit(d).alias("shard_depth")))
        level = level.drop("parts")
    found.append(level.filter(fits("", base)).withColumn("shard_depth", F.lit(base)))
    width = lambda n: f"shiftleft(prefix + {n}, {depth} - shard_depth)"
    cells = F.explode(F.expr(f"sequence({width(0)}, {width(1)} - 1)")).alias("cell")
    return reduce(DataFrame.unionByName, found).select(cells, "shard_depth", "prefix", "shard_bytes", "shard_rows")


def shards(docs: DataFrame, limit: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_bytes, shard (its bits, '' if all rows fit one shard), shard_depth,
    shard_bytes, shard_rows, oversized.

    limit: bytes of UTF-8 text per shard. A null text has no bytes. A row larger than the limit gets a shard of its
    own, marked oversized. Repeated rows are spread like any others. An empty table gives no rows.
    """
    rows = save(hashed_rows(docs, text, doc_id), "hashed")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    base, depth, placed = 0, min(BITS, max(1, (int(total) // limit).bit_length() + SPARE_BITS)), []
    while True:
        entries = save(directory(rows, limit, base, depth), "directory")
        found = rows.withColumn("cell", _prefix(depth)).join(entries, "cell", "left")
        placed.append(found.filter("shard_depth IS NOT NULL").select("doc_id", "n_bytes", "shard_depth", "prefix", "shard_bytes", "shard_rows"))
        # Only rows below prefixes that are too large go on; the driver learns no more than how many there are.
        if depth == BITS:
            break
        rows = save(found.filter("shard_depth IS NULL").select("doc_id", "n_bytes", "hash"), "oversized")
        if not rows.limit(1).count():
            break
        base, depth = depth + 1, min(BITS, depth + SPARE_BITS)
    return reduce(DataFrame.unionByName, placed).select(
        "doc_id",
        "n_bytes",
        F.when(F.col("shard_depth") == 0, "").otherwise(F.expr("substr(lpad(bin(prefix), 60, '0'), 61 - shard_depth)")).alias("shard"),
        "shard_depth",
        "shard_bytes",
        "shard_rows",
        (F.col("shard_bytes") > limit).alias("oversized"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write docs (unique, non-null ids) as one folder per shard."""
    placed = docs.join(assigned.select(F.col("doc_id").alias(doc_id), F.col("shard").alias("_shard")), doc_id)
    placed.repartition("_shard").sortWithinPartitions("_shard", doc_id).write.partitionBy("_shard").mode("overwrite").parquet(path)

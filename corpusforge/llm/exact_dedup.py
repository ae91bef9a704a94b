"""Exact dedup by a heavy-hitter split; DataFrame functions only.

Misra-Gries counters propose frequent digests. Their exact winners, verified by a count, are broadcast and applied
on the map side; every other digest takes an ordinary shuffle, where no group exceeds its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import BLANKS, save, text_of

#: Misra-Gries counters; any digest with more than 1/COUNTERS of the rows is surely among the candidates.
COUNTERS = 512


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without ``[\\x20\\x09-\\x0D]``; a null text counts as empty. Of a group the row with
    most code points stays, then the smallest doc_id; a null doc_id comes after all others, and of fully repeated
    rows exactly one is kept. An empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    content = text_of(text)
    rows = save(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.length(content).alias("code_points"),
            F.sha2(F.translate(content, BLANKS, ""), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    # Bitwise complements turn "smallest" into "largest" without overflow; null sorts lowest, thus last.
    best = F.max(F.struct("code_points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row")))
    size = F.count(F.lit(1))

    total = rows.count()
    # At most `counters` rows, whatever the input: that is the bound of both broadcasts.
    candidates = rows.stat.freqItems(["digest"], 1.0 / counters).select(F.explode("digest_freqItems").alias("digest"))
    winners = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(best.alias("best"), size.alias("group_size"))
        .filter(F.col("group_size") * counters >= total)
    )
    winners = save(winners, "winners")

    frequent = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    others = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "*", best.over(group).alias("best"), size.over(group).alias("group_size")
    )
    return frequent.select(others.columns).unionByName(others).select(
        "doc_id",
        F.bitwise_not("best.id").alias("keep_id"),
        "group_size",
        (F.bitwise_not("best.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without exact duplicates, by the same rules; needs unique, non-null ids."""
    kept = exact_duplicates(docs, text, doc_id).filter("kept").select(F.col("doc_id").alias(doc_id))
    return docs.join(kept, doc_id, "left_semi")

"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight is a schedule over training time. Its integral is the source's cumulative token demand;
inverting it turns the words a source has given so far into a training position, and a range sort by position
interleaves the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import hash60, save, text_of, word_count

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: How much a source's weight changes over training: at time t it is weight * (1 + ramp * (2t - 1)); repeating.
RAMPS = (-0.5, 0.0, 0.5)
#: The mix takes BUDGET_HALVES / 2 of all words, and at most CAP times a source's words.
BUDGET_HALVES = 3
CAP = 2
#: Ranges of the hash order; running sums are taken within one, so a source of any size is spread over many tasks.
RANGES = 4096


def _cycle(values: tuple, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sources_with_targets(sizes: DataFrame, weights: tuple = WEIGHTS, ramps: tuple = RAMPS) -> DataFrame:
    """Per source: source, weight, ramp, source_size, target; sizes has source and size.

    Targets share the budget by weight, but none exceeds CAP times its source's size: with sources in order of
    size / weight the smallest are capped, as many as needed, and the rest share what is left.
    """
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    named = named.select("*", _cycle(weights, place).cast("long").alias("weight"), _cycle(ramps, place).alias("ramp"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # If this source and all after it share what the capped ones before leave, their level is:
    level = (F.sum("source_size").over(everything) * (BUDGET_HALVES / 2) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    named = named.select("*", level.alias("level"))
    open_ = F.col("level") * F.col("weight") <= CAP * F.col("source_size")
    # The level of the first source that isn't capped holds for all after it.
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = named.select("*", F.first(F.when(open_, F.col("level")), ignorenulls=True).over(so_far).alias("shared"))
    target = F.when(F.col("shared").isNull(), CAP * F.col("source_size")).otherwise(F.least(F.col("shared") * F.col("weight"), CAP * F.col("source_size").cast("double")))
    return named.select("source", "weight", "ramp", "source_size", target.cast("double").alias("target"))


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, ramps: tuple = RAMPS, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, first_position (null if not taken),
    offset, ramp and slot, which no other row has; with carry also row, a struct of all input columns.

    Documents are taken whole, each floor(target / source_size) times; a prefix of the source's hash order is taken
    once more, up to the document whose middle passes the target. A null text has size 0, a null source is a source.
    A source of size 0 takes nothing. Order depends on id and size only, so reruns agree; rows that share both are
    interchangeable. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows, narrow, starts = _sized(docs, text, doc_id, source, weights, ramps)
    return _planned(rows if carry else narrow, starts)


def _sized(docs: DataFrame, text: str, doc_id: str, source: str, weights: tuple, ramps: tuple) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs with size, hash, range and row; the same without row, saved; where each range of a source starts, with the
    source's target, saved."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text_of(text)).alias("size"), row)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    # Keys that can't be null: the window and the join are partitioned alike, so rows with texts move once, and the join has
    # no null filter, which would count the words once more.
    rows = rows.withColumn("hash", hash60(key)).withColumn("range", F.coalesce(F.shiftright("hash", 48).cast("int"), F.lit(0)))
    rows = rows.withColumn("from", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    narrow = save(rows.drop("row"), "sizes")
    ranges = save(narrow.groupBy("from", "source", "range").agg(F.sum("size").alias("size")), "ranges")
    targets = sources_with_targets(ranges, weights, ramps)
    earlier = Window.partitionBy("from").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("from", "source", "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(targets.withColumnRenamed("source", "t"), F.expr("source <=> t")).drop("source", "t")
    return rows, narrow, save(starts, "starts")


def _planned(rows: DataFrame, starts: DataFrame) -> DataFrame:
    row = ["row"] if "row" in rows.columns else []
    within = Window.partitionBy("from", "range").orderBy("hash", "doc_id", "size")
    inner = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("*", inner.alias("inner"), F.row_number().over(within).alias("place"))
    rows = rows.join(starts, ["from", "range"]).withColumn("offset", F.col("start") + F.col("inner"))
    passes = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    rows = rows.withColumn("passes", passes.cast("long"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("offset") + F.col("size") / 2 <= rest)
    rows = rows.withColumn("copies", F.when(more, F.col("passes") + 1).otherwise(F.col("passes")))
    first = F.when(F.col("copies") > 0, position(F.col("offset") + F.col("size") / 2, F.col("target"), F.col("ramp")))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
        first.alias("first_position"), "offset", "ramp", F.struct("from", "range", "place").alias("slot"), *row,
    )


def position(words: Column, target: Column, ramp: Column) -> Column:
    """Training time in [0, 1] at which a source has given `words` of its target: the inverse of the integral
    t * (1 - ramp) + ramp * t^2 of its schedule."""
    share = F.least(F.lit(1.0), words / target)
    flat = 1 - ramp
    return F.when(ramp == 0, share).otherwise((F.sqrt(flat * flat + 4 * ramp * share) - flat) / (2 * ramp))


def in_order(planned: DataFrame) -> DataFrame:
    """The rows of a plan, as often as they are taken, with copy (from 0) and position: range-sorted by position, then id
    and copy."""
    copies = planned.filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    given = F.col("offset") + F.col("copy") * F.col("source_size") + F.col("size") / 2
    return copies.withColumn("position", position(given, F.col("target"), F.col("ramp"))).orderBy("position", "doc_id", "copy")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, ramps: tuple = RAMPS) -> DataFrame:
    """The training order: docs' rows, as often as they are taken, range-sorted by position, then id and copy.

    Null, empty and wordless texts are never taken. Rows that share id and size are interchangeable in the order. All
    columns stay, whatever their names; an empty table gives no rows.
    """
    return in_order(plan(docs, text, doc_id, source, weights, ramps, carry=True)).select("row.*")


def taken_in_order(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple = WEIGHTS, ramps: tuple = RAMPS) -> DataFrame:
    """The rows of plan, but taken, copies and first_position (null if not taken) are read back from the mix: its texts are
    sorted into training order, their words counted and written in that order. Rows come in the order in which the mix first
    has them, those not taken last."""
    rows, narrow, starts = _sized(docs, text, doc_id, source, weights, ramps)
    mixed = in_order(_planned(rows, starts)).select("slot", "position", word_count(text_of(f"row.{text}")).alias("words"))
    found = save(mixed, "order").groupBy("slot").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("copies"), F.min("position").alias("first_position"))
    planned = _planned(narrow, starts).drop("taken", "copies", "first_position")
    return planned.join(found, "slot", "left").fillna(0, ["taken", "copies"]).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")

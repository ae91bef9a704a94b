"""Line dedup by a log-template tree; DataFrame functions only.

A line's variable fields (numbers, hexadecimal ids, addresses) are masked. The tree has a fixed depth: the first level
is the token count, the next ones are the leading tokens. A line goes if a document with a smaller id has its template,
or another one of its leaf that agrees with it in enough positions; the differing positions are further variable fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import BLANKS, WORD_SEPARATOR, bit_filter, may_have, save, text_of

#: Lines of fewer tokens are left alone: short lines recur by chance.
MIN_TOKENS = 5
#: Leading tokens that are levels of the tree.
LEADING = 3
#: Share of positions in which a template must agree with an earlier one of its leaf.
SIMILARITY = 0.8
#: Rounds in which templates are compared with the first of their block only.
HEADS = 2

#: A token with one of these anywhere is a variable field: a digit, an address, a link.
VARIABLE = r"[0-9@]|://"
#: Templates of a leaf that are compared in one row; a larger leaf goes by blocks.
SMALL_LEAF = 16
_FIRST, _LAST = -(2**63), 2**63 - 1


def _owner(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(_LAST))


def _lines(docs: DataFrame, min_tokens: int, leading: int) -> DataFrame:
    """owner, row, pos, leaf, template, codes of each line with enough tokens; codes: its masked tokens' hashes."""

    # A masked line keeps its token count, for only characters of tokens are replaced. Most lines have nothing to mask, and
    # splitting them at a plain space needs no regular expression.
    def tokens(line: Column) -> Column:
        plain = F.btrim(line, F.lit(BLANKS))
        masked = F.regexp_replace(plain, r"[^\x20\x09-\x0D]*(?:" + VARIABLE + r")[^\x20\x09-\x0D]*", "<*>")
        # One class of characters and plain searches: much cheaper than alternatives of a regular expression.
        odd = plain.rlike(r"[0-9@\x09-\x0D]") | plain.contains("://") | plain.contains("  ")
        return F.when(odd, F.split(masked, WORD_SEPARATOR)).otherwise(F.split(plain, " "))

    # Split inside the generator: as a column, the filter would split every line a second time.
    lines = docs.select("owner", "row", F.posexplode(F.transform(F.split("content", "\n", -1), tokens)).alias("pos", "tokens"))
    lines = lines.filter(F.size("tokens") >= min_tokens)
    return lines.select(
        "owner",
        "row",
        "pos",
        F.xxhash64(F.size("tokens"), F.slice("tokens", 1, leading)).alias("leaf"),
        F.xxhash64("tokens").alias("template"),
        F.transform("tokens", lambda t: F.hash(t)).alias("codes"),
    )


def _same(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e))


def _repeats_in_small_leaves(codes: DataFrame, similarity: float) -> DataFrame:
    """As _repeats, for leaves of at most SMALL_LEAF templates, each gathered in a row."""
    rows = codes.groupBy("leaf").agg(F.collect_list(F.struct("template", "owner", "codes")).alias("all"))
    earlier = lambda t: F.exists("all", lambda o: (o["owner"] < t["owner"]) & (_same(t["codes"], o["codes"]) >= F.size(t["codes"]) * similarity))
    return rows.select(F.explode(F.transform(F.filter("all", earlier), lambda t: t["template"])).alias("template"))


def _repeats(codes: DataFrame, leading: int, similarity: float) -> DataFrame:
    """template: each of codes (leaf, template, owner, codes) for which its leaf has one of a smaller owner that agrees
    with it in enough positions.

    Exact: if at most k positions may differ, one of k + 1 parts of the positions is equal, so like templates share a
    block. A block's first template is tried HEADS times, each time by those that found none yet; then these try all.
    """
    n, m = F.size("codes"), F.greatest(F.size("codes") - leading, F.lit(0))
    differ = n - F.ceil(n * similarity - 1e-9)
    parts = F.when(differ < m, differ + 1).otherwise(1).cast("int")
    start = lambda i: F.floor(i * m / parts).cast("int")
    # Where all may differ, there is one part without positions: the leaf.
    part = lambda i: F.xxhash64("leaf", i, F.slice("codes", start(i) + leading + 1, F.when(differ < m, start(i + 1) - start(i)).otherwise(0)))
    blocks = codes.select("template", "owner", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), part)).alias("block"))
    shared = blocks.groupBy("block").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low < high").select("block", "low")
    blocks = save(blocks.join(shared, "block"), "blocks")
    a, b = (codes.select(F.col("template").alias(t), F.col("codes").alias(c)) for t, c in (("template", "x"), ("other", "y")))
    def like(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("template", "other").distinct().join(a, "template").join(b, "other")
        return save(pairs.filter(_same(F.col("x"), F.col("y")) >= F.size("x") * similarity).select("template").distinct(), "like")

    found, left = None, blocks.filter("owner > low")
    for n in range(HEADS):
        heads = (left if n else blocks).groupBy("block").agg(F.min(F.struct("owner", F.col("template").alias("other"))).alias("head"))
        taken = like(left.join(heads, "block").filter("head.owner < owner").select("template", "head.other"))
        found = taken if found is None else found.unionByName(taken)
        left = save(left.join(taken, "template", "left_anti"), "left")
    others = blocks.select("block", F.col("template").alias("other"), F.col("owner").alias("earlier"))
    return found.unionByName(like(left.join(others, "block").filter("earlier < owner")))


def dropped_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_tokens: int = MIN_TOKENS, leading: int = LEADING, similarity: float = SIMILARITY) -> DataFrame:
    """owner, row, positions: for each document that loses lines its id (the largest number for null), xxhash64 of its id
    and text, and the lines' numbers from 0."""
    content = text_of(text)
    rows = docs.select(_owner(doc_id).alias("owner"), F.xxhash64(doc_id, content).alias("row"), content.alias("content"))
    # Tokens recur, so a large dictionary stores a code in some 18 bits.
    lines = save(_lines(rows, min_tokens, leading), "lines", **{"parquet.dictionary.page.size": str(8 << 20)})
    narrow = lines.drop("codes")

    templates = save(narrow.groupBy("leaf", "template").agg(F.min("owner").alias("owner"), F.max("owner").alias("last_owner")), "templates")
    # Codes are read and sent for leaves of several templates only. Leaves are hashes; the filter has a fixed size. The join
    # is an inner one, as Spark would run a semi-join before the filter.
    leaves = save(templates.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "leaves")
    some = may_have(lines.select("leaf", "template", "owner", "codes"), "leaf", bit_filter(leaves, "leaf")).join(leaves, "leaf")
    codes = some.groupBy("leaf", "template").agg(F.min("owner").alias("owner"), F.any_value("n").alias("n"), F.any_value("codes").alias("codes"))
    codes = save(codes, "codes")
    small, large = codes.filter(F.col("n") <= SMALL_LEAF).drop("n"), codes.filter(F.col("n") > SMALL_LEAF).drop("n")
    repeats = _repeats_in_small_leaves(small, similarity).unionByName(_repeats(large, leading, similarity))
    # Only templates that some document must give up: seen in several documents, or like one of an earlier document.
    like = codes.select("leaf", "template").join(repeats.distinct(), "template")
    several = templates.filter("last_owner > owner").select("leaf", "template", F.col("owner").alias("keeper"))
    recurring = several.unionByName(like.withColumn("keeper", F.lit(_FIRST))).groupBy("leaf", "template").agg(F.min("keeper").alias("keeper"))
    recurring = save(recurring, "recurring")
    return (
        may_have(narrow, "template", bit_filter(recurring, "template"))
        .join(recurring, ["leaf", "template"])
        .filter(F.col("owner") > F.col("keeper"))
        .groupBy("owner", "row")
        .agg(F.collect_set("pos").alias("positions"))
    )


def without_recurring_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs, with text without recurring lines, and lines_dropped (long).

    Lines are parts of the text between "\\n". The document with the smallest id keeps a recurring line, every time it
    has it; all later documents lose it. Documents with a null id come last and keep what only they share. A null text
    stays null, an empty one empty; a document may end up empty. Repeated rows with equal ids are one document.
    A column of docs that is called lines_dropped is replaced; all others stay, whatever their names.
    """
    gone = dropped_lines(docs, text, doc_id, **options)
    others = F.struct(*[c for c in docs.columns if c != "lines_dropped"]).alias("doc")
    keyed = docs.select(_owner(doc_id).alias("owner"), F.xxhash64(doc_id, text_of(text)).alias("row"), others)
    # Arrays of one element, so that the split lines are bound once and not split anew for each line that is kept.
    split = F.array(F.struct(F.split(F.col(f"doc.{text}"), "\n", -1).alias("lines"), "positions"))

    def rest(s: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["positions"])
        return F.array_join(F.transform(left, lambda i: F.get(s["lines"], i)), "\n")

    joined = keyed.join(gone, ["owner", "row"], "left")
    return joined.select(
        *[
            F.when(F.col("positions").isNull(), F.col(f"doc.{text}")).otherwise(F.get(F.transform(split, rest), F.lit(0))).alias(c) if c == text else F.col(f"doc.{c}").alias(c)
            for c in docs.columns
            if c != "lines_dropped"
        ],
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("lines_dropped"),
    )

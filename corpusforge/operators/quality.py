"""Checks of a finished corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import computed_once, squeeze


def exact_dedupe(docs: DataFrame) -> DataFrame:
    """doc_id of the first document of each clean text."""
    keyed = docs.select("doc_id", F.sha2(squeeze(F.col("text")), 256).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def answers_in_context(items: DataFrame, docs: DataFrame, words: int = 8) -> DataFrame:
    """item_id, doc_id: items whose text a document contains.

    Candidates share the first of the item's inner words, at most so many; a document may continue the first and the last
    one. They are found by an equi-join on a hash of every run of so many words, so neither side is broadcast, and then
    tested. Items without inner words (one or two words) are tested with every document.
    """
    blank = r"[\x20\x09-\x0D]+"
    hashed = lambda w: F.xxhash64(F.size(w), F.array_join(w, " "))
    keyed = items.withColumn("w", F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), blank))
    keyed = keyed.withColumn("w", F.slice("w", 2, F.least(F.greatest(F.size("w") - 2, F.lit(0)), F.lit(words))))
    keyed = keyed.select("item_id", F.col("text").alias("item"), F.size("w").alias("n"), hashed("w").alias("run"))
    texts = docs.select("doc_id", "text")
    lengths = sorted(r.n for r in keyed.filter("n > 0").select("n").distinct().collect())
    tokens = texts.select("doc_id", F.split("text", blank).alias("w"))
    # A sequence that would run backwards is of a document of too few words.
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: hashed(F.slice("w", i, n))))
    every = F.concat(*[F.coalesce(runs(n), F.array().cast("array<bigint>")) for n in lengths]) if lengths else F.array().cast("array<bigint>")
    found = tokens.select("doc_id", F.explode(F.array_distinct(every)).alias("run")).join(keyed.filter("n > 0"), "run")
    candidates = found.select("doc_id", "item_id", "item").distinct().join(texts, "doc_id")
    short = texts.join(keyed.filter("n = 0").select("item_id", "item"), F.col("text").contains(F.col("item")))
    return candidates.filter(F.col("text").contains(F.col("item"))).select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id"))


#: Vectors on either side of a comparison of near_vectors.
VECTOR_TILE = 4096


def near_vectors(vectors: DataFrame, threshold: float, tile: int = VECTOR_TILE) -> DataFrame:
    """vec_id, links, smallest for each vector that isn't null or zero: how many others have a cosine of at least threshold
    with it, and the smallest id among these and its own.

    Every vector is compared with all others of its length, whatever its label, in tiles; a tile gives counts, not pairs.
    Work grows with the square of the table: this checks a finished benchmark, it does not search a corpus.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.exists("v", lambda x: x != 0)).withColumn("dims", F.size("v"))
    tiles = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    rows = rows.join(tiles, "dims").withColumn("own", F.pmod(F.xxhash64("vec_id"), "tiles").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        ids, unit = part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy())
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        links, smallest = np.zeros(len(ids), dtype=np.int64), ids.copy()
        both = part["low"].iat[0] == part["high"].iat[0]
        for start in range(0, len(ids), 512):
            some = slice(start, start + 512)
            near = unit[some] @ unit.T >= threshold
            near &= (ids[some, None] != ids) if both else part["own"].to_numpy()[some, None] != part["own"].to_numpy()
            links[some] = near.sum(axis=1)
            smallest[some] = np.minimum(ids[some], np.where(near, ids, ids.max()).min(axis=1))
        return pd.DataFrame({"vec_id": ids, "links": links, "smallest": smallest})

    found = rows.groupBy("dims", "low", "high").applyInPandas(compare, "vec_id long, links long, smallest long")
    return found.groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("smallest").alias("smallest"))


def minhash_near(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 20, rows: int = 4) -> DataFrame:
    """doc_id, near_id: documents that are near duplicates of one with a smaller id, and the smallest such one that was found.

    Candidates share a band of minimum hashes with the band's smallest id, which a pair of similarity 0.8 does with a
    probability of 0.99997; each is verified on its sets of shingles, so every row is right.
    """
    # Words and shingles are made once: as plain columns they would be made anew for each shingle and each minimum hash.
    split = computed_once(docs.select("doc_id", "text"), {"w": F.split(squeeze(F.lower("text")), " ")})
    last = F.greatest(F.size("w") - words, F.lit(0))
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice("w", i + 1, words))))
    sets = computed_once(split.select("doc_id", "w"), {"set": shingles}).select("doc_id", "set")
    least = lambda k: F.array_min(F.transform("set", lambda s: F.xxhash64(s, F.lit(k))))
    keys = F.array(*[F.xxhash64(F.lit(b), *[least(b * rows + r) for r in range(rows)]) for b in range(bands)])
    banded = sets.select("doc_id", F.explode(keys).alias("band"))
    first = banded.groupBy("band").agg(F.min("doc_id").alias("near_id"), F.max("doc_id").alias("last_id")).filter("near_id < last_id")
    pairs = banded.join(first.drop("last_id"), "band").filter("doc_id > near_id").select("doc_id", "near_id").distinct()
    both = pairs.join(sets, "doc_id").join(sets.withColumnsRenamed({"doc_id": "near_id", "set": "near"}), "near_id")
    common = F.size(F.array_intersect("set", "near"))
    alike = both.filter(common >= threshold * (F.size("set") + F.size("near") - common))
    return alike.groupBy("doc_id").agg(F.min("near_id").alias("near_id"))


def answer_support(pairs: DataFrame, answer: str = "answer", context: str = "context") -> DataFrame:
    """pairs with support: the share of the answer's different words, in any case and without punctuation, that the context
    has; 0 for an answer without words."""
    words = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")), "")
    asked = F.size(words(answer))
    return pairs.withColumn("support", F.when(asked == 0, 0.0).otherwise(F.size(F.array_intersect(words(answer), words(context))) / asked))


#: A few very frequent words of each language.
FREQUENT = {"en": ["the", "and", "of", "that"], "fr": ["le", "et", "les", "des"], "de": ["der", "und", "die", "von"], "es": ["el", "los", "que", "para"]}


def language_tag(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with tag: the language whose frequent words the text has most of; und without any."""
    worded = computed_once(docs, {"_words": F.split(F.lower(text), r"[^\p{L}]+")})

    def score(language: str, frequent: list[str]) -> Column:
        return F.struct(F.size(F.filter("_words", lambda w: w.isin(*frequent))).alias("n"), F.lit(language).alias("k"))

    scores = [score(k, v) for k, v in FREQUENT.items()]
    best = F.array_max(F.array(*scores))
    return worded.withColumn("tag", F.when(best["n"] > 0, best["k"]).otherwise("und")).drop("_words")


def first_turns(conversations: DataFrame) -> DataFrame:
    """question, answer of each user turn that an assistant's follows, with conv_id and turn."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("*", F.lead("role").over(order).alias("_role"), F.lead("text").over(order).alias("answer"))
    return rows.filter("role = 'user' AND _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")

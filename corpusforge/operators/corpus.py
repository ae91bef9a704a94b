"""From nested publications to the flat corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.localized import languages_of, pick_text
from corpusforge.functions.text import clean_text, computed_once, context, first_claim, word_count
from corpusforge.schemas import CORPUS_COLUMNS, LANGUAGES, MIN_WORDS, SOURCE_NAME


def by_language(pubs: DataFrame, languages: list[str] | None = None, claims: bool = True) -> DataFrame:
    """One row for each publication and language that it has a title or an abstract in: ord, language, the picked raw
    texts, and flat columns."""
    wanted = F.array(*map(F.lit, languages or LANGUAGES))
    present = F.array_union(languages_of("title_localized"), languages_of("abstract_localized"))
    rows = pubs.withColumn("language", F.explode(F.array_intersect(present, wanted)))
    picked = lambda c: pick_text(c, F.col("language")) if claims and c in pubs.columns else F.lit(None).cast("string")
    return rows.select(
        "ord",
        "language",
        F.coalesce("publication_number", F.lit("")).alias("publication_number"),
        F.coalesce("country_code", F.lit("")).alias("country_code"),
        F.when(F.col("publication_date") != 0, F.col("publication_date").cast("string")).otherwise("").alias("publication_date"),
        pick_text("title_localized", F.col("language")).alias("title"),
        pick_text("abstract_localized", F.col("language")).alias("abstract"),
        picked("claims_localized_html").alias("claim_markup"),
        picked("claims_localized").alias("claim_text"),
    )


def first_by_key(rows: DataFrame) -> DataFrame:
    """The first row, by ord, of each language and publication number; rows without a number share the key ""."""
    order = Window.partitionBy("language", "publication_number").orderBy("ord")
    return rows.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def gated(rows: DataFrame, least_words: int = MIN_WORDS) -> DataFrame:
    return rows.filter(word_count(F.col("abstract")) >= least_words)


def capped(rows: DataFrame, cap: int | None) -> DataFrame:
    """The first `cap` rows of each language by ord; none or 0: all."""
    if not cap:
        return rows
    order = Window.partitionBy("language").orderBy("ord")
    return rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= cap).drop("_place")


def cleaned(rows: DataFrame) -> DataFrame:
    return computed_once(rows, {c: clean_text(F.col(c)) for c in ("title", "abstract")})


def _claim(pubs: DataFrame) -> Column:
    """First claim of rows that by_language made of pubs; "" without reading anything if pubs has no claims."""
    if not {"claims_localized", "claims_localized_html"} & {*pubs.columns}:
        return F.lit("")
    return F.coalesce(first_claim(F.col("claim_markup"), F.col("claim_text")), F.lit(""))


def preprocess(pubs: DataFrame, languages: list[str] | None = None, per_language: int | None = None, least_words: int = MIN_WORDS) -> DataFrame:
    """The corpus columns and ord. Duplicates go before short abstracts do, so a short first record hides a later one."""
    rows = capped(gated(cleaned(first_by_key(by_language(pubs, languages))), least_words), per_language)
    rows = rows.withColumn("first_claim", _claim(pubs))
    return rows.select(
        F.concat("publication_number", F.lit("_"), "language").alias("id"),
        "language",
        "title",
        "abstract",
        F.lit("").alias("description"),
        "first_claim",
        context(F.col("title"), F.col("abstract"), F.col("first_claim")).alias("context"),
        "publication_number",
        "country_code",
        "publication_date",
        F.lit(SOURCE_NAME).alias("source"),
        "ord",
    )


def merge(corpus: DataFrame, least_words: int = MIN_WORDS) -> DataFrame:
    """Every text column cleaned once more, which leaves single spaces in contexts, and the gate applied again."""
    texts = ["title", "abstract", "description", "first_claim", "context"]
    rows = gated(computed_once(corpus, {c: clean_text(F.col(c)) for c in texts}), least_words)
    rebuilt = context(F.col("title"), F.col("abstract"), F.col("first_claim"))
    return rows.withColumn("context", F.when(F.col("context") == "", rebuilt).otherwise(F.col("context"))).select(corpus.columns)


def in_output_order(corpus: DataFrame, languages: list[str] | None = None) -> DataFrame:
    position = F.array_position(F.array(*map(F.lit, languages or LANGUAGES)), F.col("language"))
    return corpus.orderBy(position, "ord").select(CORPUS_COLUMNS)


def language_stats(pubs: DataFrame, languages: list[str] | None = None, least_words: int = MIN_WORDS) -> DataFrame:
    """language, written, skipped_short, missing_claim, without a cap."""
    rows = cleaned(first_by_key(by_language(pubs, languages)))
    long = word_count(F.col("abstract")) >= least_words
    claim = _claim(pubs)
    return rows.groupBy("language").agg(
        F.count_if(long).alias("written"), F.count_if(~long).alias("skipped_short"), F.count_if(long & (claim == "")).alias("missing_claim")
    )

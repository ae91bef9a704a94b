"""Selecting publications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.localized import class_prefix, has_text, languages_of, languages_present
from corpusforge.functions.text import least_characters
from corpusforge.schemas import CLASS_PREFIXES, LANGUAGES, MIN_WORDS, OVERFETCH_FACTOR, OVERFETCH_LEAST


def fetch_size(n: int) -> int:
    """Rows to fetch so that n are left after a word gate."""
    return max(n + OVERFETCH_LEAST, int(n * OVERFETCH_FACTOR))


def with_match(pubs: DataFrame, match: DataFrame) -> DataFrame:
    """pubs with has_match: whether match has the publication number."""
    keys = match.select("publication_number").distinct().withColumn("_matched", F.lit(True))
    return pubs.join(keys, "publication_number", "left").withColumn("has_match", F.col("_matched").isNotNull()).drop("_matched")


def class_match(cpc: list[str] | None = None, ipc: list[str] | None = None) -> Column:
    return class_prefix("cpc", cpc or CLASS_PREFIXES) | class_prefix("ipc", ipc or CLASS_PREFIXES)


def claim_gate(language: Column | None = None) -> Column:
    return has_text("claims_localized", language) | has_text("claims_localized_html", language)


def _base(pubs, match, cpc, ipc, by_class, start_date, end_date, countries) -> DataFrame:
    if match is None and not by_class:
        raise ValueError("select by class, by match, or by both")
    flat = []
    if start_date is not None:
        flat.append(F.col("publication_date") >= start_date)
    if end_date is not None:
        flat.append(F.col("publication_date") <= end_date)
    if countries:
        flat.append(F.col("country_code").isin(*countries))
    for predicate in flat:  # flat predicates first: they reach the scan
        pubs = pubs.filter(predicate)
    chosen = [class_match(cpc, ipc)] if by_class else []
    if match is not None:
        pubs = with_match(pubs, match)
        chosen.append(F.col("has_match"))
    return pubs.filter(reduce(lambda a, b: a | b, chosen)).drop("has_match")


def select_publications(
    pubs: DataFrame, match: DataFrame | None = None, *, languages: list[str] | None = None, cpc_prefixes: list[str] | None = None,
    ipc_prefixes: list[str] | None = None, use_classification: bool = True, require_multilingual: bool = False, min_language_count: int = 2,
    limit: int | None = None, primary_lang: str | None = None, min_primary_abstract_words: int | None = None,
    require_primary_description: bool = False, enforce_description: bool = False, require_primary_claim: bool = False,
    require_any_claim: bool = False, start_date: int | None = None, end_date: int | None = None, country_codes: list[str] | None = None,
) -> DataFrame:
    """Publications by class or match, date, country and language, most recent first, with languages_present.

    match=None turns the match off. require_any_claim counts only without primary_lang; require_primary_description
    is accepted but has no effect unless enforce_description is set.
    """
    rows = _base(pubs, match, cpc_prefixes, ipc_prefixes, use_classification, start_date, end_date, country_codes)
    if primary_lang:
        primary = F.lit(primary_lang)
        least = least_characters(min_primary_abstract_words) if min_primary_abstract_words else 1
        rows = rows.filter(has_text("abstract_localized", primary, least))
        if require_primary_claim:
            rows = rows.filter(claim_gate(primary))
        if require_primary_description and enforce_description:
            rows = rows.filter(has_text("description_localized", primary))
    elif require_any_claim:
        rows = rows.filter(claim_gate())
    rows = rows.withColumn("languages_present", languages_present(languages or LANGUAGES))
    if require_multilingual:
        rows = rows.filter(F.size("languages_present") >= min_language_count)
    rows = rows.orderBy(F.desc("publication_date"), F.desc("publication_number"))
    return rows.limit(limit) if limit else rows


def top_n_per_language(
    pubs: DataFrame, n: int, match: DataFrame | None = None, *, languages: list[str] | None = None, cpc_prefixes: list[str] | None = None,
    ipc_prefixes: list[str] | None = None, use_classification: bool = True, min_abstract_words: int = MIN_WORDS, require_claim: bool = False,
    start_date: int | None = None, end_date: int | None = None, country_codes: list[str] | None = None,
) -> DataFrame:
    """Publications among the n most recent of some language with a long enough abstract.

    Ranks are found on keys only; the wide rows join once, as a semi-join.
    """
    base = _base(pubs, match, cpc_prefixes, ipc_prefixes, use_classification, start_date, end_date, country_codes)
    wanted = F.array(*map(F.lit, languages or LANGUAGES))
    keys = base.withColumn("lang", F.explode(F.array_intersect(languages_of("abstract_localized"), wanted)))
    keys = keys.filter(has_text("abstract_localized", F.col("lang"), least_characters(min_abstract_words)))
    if require_claim:
        keys = keys.filter(claim_gate(F.col("lang")))
    order = Window.partitionBy("lang").orderBy(F.desc("publication_date"), F.desc("publication_number"))
    ranked = keys.select("publication_number", "publication_date", "lang").withColumn("rn", F.row_number().over(order))
    chosen = ranked.filter(F.col("rn") <= n).select("publication_number").distinct()
    return base.join(chosen, "publication_number", "left_semi").orderBy(F.desc("publication_date"), F.desc("publication_number"))


def most_recent(pubs: DataFrame, n: int) -> DataFrame:
    return pubs.orderBy(F.desc("publication_date"), F.desc("publication_number"), "ord").limit(n)

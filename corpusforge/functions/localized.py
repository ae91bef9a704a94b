"""Functions of arrays of localized texts and of codes.

Fields are taken as ``col("array.field")``, never inside a lambda: only so does the scan read just those fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.text import strip


def _pairs(column: str) -> Column:
    """(language, text) of the array's entries; a null array has none."""
    zipped = F.arrays_zip(F.col(f"{column}.language").alias("language"), F.col(f"{column}.text").alias("text"))
    return F.coalesce(zipped, F.array().cast("array<struct<language:string,text:string>>"))


def _language(pair: Column) -> Column:
    return F.lower(F.coalesce(pair["language"], F.lit("")))


def pick_text(column: str, language: Column) -> Column:
    """The first text in this language, in any case, that isn't blank, stripped; else null."""
    fitting = F.filter(_pairs(column), lambda p: (_language(p) == F.lower(language)) & (strip(p["text"]) != ""))
    return strip(F.get(F.transform(fitting, lambda p: p["text"]), F.lit(0)))


def languages_of(column: str) -> Column:
    """Distinct lower-case languages with a text that isn't blank."""
    return F.array_distinct(F.transform(F.filter(_pairs(column), lambda p: strip(p["text"]) != ""), _language))


def languages_present(languages: list[str], title: str = "title_localized", abstract: str = "abstract_localized") -> Column:
    """Sorted languages of the list, as written, that title or abstract have; blank texts count, null ones don't."""
    wanted = F.array(*map(F.lit, languages))
    of = lambda c: F.transform(F.filter(_pairs(c), lambda p: p["text"].isNotNull() & F.array_contains(wanted, p["language"])), lambda p: p["language"])
    return F.array_sort(F.array_union(of(title), of(abstract)))


def has_text(column: str, language: Column | None = None, least: int = 1) -> Column:
    """Whether some text, of this language if given, has at least so many characters between its white space."""

    def fits(p: Column) -> Column:
        long = F.coalesce(F.length(strip(p["text"])) >= max(least, 1), F.lit(False))
        return long if language is None else long & (_language(p) == language)

    return F.exists(_pairs(column), fits)


def class_prefix(column: str, prefixes: list[str]) -> Column:
    """Whether some code starts with one of the prefixes; null arrays and codes don't."""
    codes = F.coalesce(F.col(f"{column}.code"), F.array().cast("array<string>"))
    return F.coalesce(F.exists(codes, lambda c: reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])), F.lit(False))

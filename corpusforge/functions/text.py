"""Text functions: Column -> Column. All of them run in the JVM, but for decoding entities, which only texts with an
ampersand reach."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusforge.schemas import CHARS_PER_WORD, MIN_CHARS, SNIPPET_CHARS, WS


@F.pandas_udf(StringType())
def _decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


_TERMINATED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|([0-9A-Za-z]+));")


def _terminated(found: re.Match) -> str:
    return html.unescape(found[0]) if found[1] is None or f"{found[1]};" in html5 else found[0]


@F.pandas_udf(StringType())
def _decode_terminated_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _TERMINATED.sub(_terminated, t), na_action="ignore")


def html_unescape(text: Column, bare: bool = True) -> Column:
    """HTML5 entities decoded once; texts without "&" never leave the JVM. bare: also those without their semicolon, as
    HTML5 and Python read them ("&amp</b>", "&ampx;"); otherwise these stay as they are."""
    decode = _decode_entities if bare else _decode_terminated_entities
    return F.coalesce(decode(F.when(text.contains("&"), text)), text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, none at the ends; null to ""."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " "), F.lit(" "))


def clean_text(text: Column, entities: bool = True, bare: bool = True) -> Column:
    return squeeze(html_unescape(text, bare) if entities else text)


def word_count(cleaned: Column) -> Column:
    """Words of a clean text; a script without spaces counts as one word. The text is named once, so it is made once."""
    return F.size(F.array_remove(F.split(cleaned, " "), "")).cast("long")


def computed_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with these columns, made once a row whatever follows: as plain columns, every filter and projection behind them
    would have a copy of their expressions, regular expressions and entity decoding included."""
    made = rows.select("*", F.struct(*[v.alias(c) for c, v in columns.items()]).alias("_made"))
    others = [c for c in rows.columns if c not in columns]
    return made.select(*others, F.explode(F.array("_made")).alias("_made")).select(*others, *[F.col(f"_made.{c}").alias(c) for c in columns])


def least_characters(words: int) -> int:
    """The cheap character gate that stands for a gate of so many words."""
    return max(MIN_CHARS, words * CHARS_PER_WORD)


def truncate(cleaned: Column, characters: int = SNIPPET_CHARS) -> Column:
    """A clean text cut to so many characters, without its last, maybe broken, word."""
    cut = F.left(cleaned, F.lit(characters))
    whole = F.btrim(F.regexp_replace(cut, r" [^ ]*\z", ""), F.lit(" "))
    return F.when(F.length(cleaned) <= characters, cleaned).otherwise(F.when(whole == "", F.btrim(cut, F.lit(" "))).otherwise(whole))


_LEADING_ONE = rf"^{WS}*1{WS}*[\.\):\-]*{WS}*"


def normalize_claim(text: Column, entities: bool = True) -> Column:
    return strip(F.regexp_replace(clean_text(text, entities), _LEADING_ONE, ""))


def claim_from_html(markup: Column, entities: bool = True) -> Column:
    block = F.regexp_extract(markup, r"(?is)<claim\b[^>]*>(.*?)</claim>", 1)
    for pattern in (r"(?is)<chemistry\b.*?</chemistry>", r"(?i)</?claim-text\b[^>]*>", r"<[^>]+>"):
        block = F.regexp_replace(block, pattern, " ")
    return normalize_claim(F.coalesce(block, F.lit("")), entities)


def claim_from_text(text: Column, entities: bool = True) -> Column:
    numbered = F.regexp_replace(clean_text(text, entities), _LEADING_ONE, "")
    first = F.get(F.split(numbered, rf"{WS}2{WS}*[\.\):\-]{WS}+", 2), F.lit(0))
    return normalize_claim(first, entities)


def first_claim(markup: Column, text: Column, characters: int = SNIPPET_CHARS, entities: bool = True) -> Column:
    found = F.coalesce(F.nullif(claim_from_html(markup, entities), F.lit("")), claim_from_text(text, entities))
    return truncate(clean_text(found, entities), characters)


def description_snippet(text: Column, characters: int = SNIPPET_CHARS, entities: bool = True) -> Column:
    return truncate(clean_text(F.regexp_replace(text, r"(?U)\[\d{3,5}\]", " "), entities), characters)


def context(title: Column, abstract: Column, claim: Column) -> Column:
    parts = (("Title: ", title), ("Abstract: ", abstract), ("First claim: ", claim))
    return F.concat_ws("\n\n", *[F.when(part != "", F.concat(F.lit(name), part)) for name, part in parts])

"""Decisions on generated and translated pairs as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.text import strip
from corpusforge.schemas import BROAD_OPENINGS, DOCUMENT_PHRASES, QUESTION_TYPES, SEVERITIES, TRANSLATION_FAILURES, WS


def parse_json(text: Column, schema: str) -> Column:
    """A model's JSON answer, with or without a code fence around it; an answer that isn't JSON gives null fields."""
    body = strip(text)
    fenced = F.regexp_replace(F.regexp_replace(body, r"(?s)\A```[^\n]*\n?", ""), r"(?s)```(?:(?!```).)*\z", "")
    return F.from_json(F.when(body.startswith("```"), fenced).otherwise(body), schema, {"mode": "PERMISSIVE"})


def _stated(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def reason_format(reason: Column, failure_type: Column, better_direction: Column) -> Column:
    reason, failure, better = _stated(reason), _stated(failure_type), _stated(better_direction)
    named = F.when(failure.isin("", "none"), reason).when(reason == "", failure).otherwise(F.concat(failure, F.lit(": "), reason))
    return F.when(better == "", named).otherwise(strip(F.concat(named, F.lit(" Better direction: "), better)))


def retry_feedback(reason: Column, failure_type: Column, better_direction: Column) -> Column:
    """What a translator is told before another attempt."""
    reason, failure, better = _stated(reason), _stated(failure_type), _stated(better_direction)
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("."))
    return F.concat_ws(
        " ",
        F.when(~failure.isin("", "none"), named("Failure type", failure)),
        F.when(reason != "", named("Reason", reason)),
        F.when(better != "", named("Better direction", better)),
    )


def severity_of(severity: Column) -> Column:
    given = F.lower(_stated(severity))
    return F.when(given.isin(*SEVERITIES), given).otherwise("high")


def failure_of(failure_type: Column) -> Column:
    given = F.lower(F.coalesce(strip(failure_type), F.lit("none")))
    return F.when(given == "", "none").when(given.isin(*TRANSLATION_FAILURES), given).otherwise("meaning-error")


def translation_approved(v: dict[str, Column]) -> Column:
    """v: language_ok, meaning_ok, technical_ok, specificity_ok, terminology_ok, artifact_ok, fluency_ok, grammar_ok,
    severity. Missing flags: the first four and fluency count as false, the others as true."""
    strict = ["language_ok", "meaning_ok", "technical_ok", "specificity_ok", "fluency_ok"]
    flag = {name: F.coalesce(v[name], F.lit(name not in strict)) for name in v if name.endswith("_ok")}
    must = ["language_ok", "meaning_ok", "technical_ok", "specificity_ok", "terminology_ok", "artifact_ok"]
    serious = severity_of(v["severity"]) != "low"
    return reduce(lambda a, b: a & b, [flag[m] for m in must]) & ~(serious & ~(flag["grammar_ok"] & flag["fluency_ok"]))


def question_lint(question: Column, question_type: Column) -> dict[str, Column]:
    lower = F.lower(question)
    return {
        "document_centred": reduce(lambda a, b: a | b, [lower.contains(p) for p in DOCUMENT_PHRASES]),
        "broad_opening": reduce(lambda a, b: a | b, [lower.startswith(p) for p in BROAD_OPENINGS]),
        "known_type": question_type.isin(*QUESTION_TYPES),
    }


def translation_lint(text: Column) -> dict[str, Column]:
    return {
        "slash_alternatives": text.rlike(r"[A-Za-z]{3,}/[A-Za-z]{3,}"),
        "gloss": text.rlike(r"\([A-Za-z ]{4,}\)"),
        "mixed_script": text.rlike(r"[\x{0400}-\x{04ff}]") & text.rlike(r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]"),
    }


def length_and_format(question: Column, answer: Column) -> Column:
    words = lambda c: F.size(F.split(c, f"{WS}+"))
    return (words(strip(question)).between(3, 60)) & (words(strip(answer)) <= 120) & strip(question).endswith("?")


def status_text(question_type: Column, translations: Column, failures: Column) -> Column:
    """failures: array of "language (reason)"."""
    skipped = F.concat(F.lit(", skipped "), F.size(failures).cast("string"), F.lit(": "), F.array_join(failures, ", "))
    kind = F.when(F.coalesce(question_type, F.lit("")) == "", F.lit("validated")).otherwise(question_type)
    tail = F.when(F.size(failures) > 0, skipped).otherwise("")
    return F.concat(F.lit("ok ("), kind, F.lit(" en + "), translations.cast("string"), F.lit(" translations"), tail, F.lit(")"))

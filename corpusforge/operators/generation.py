"""Question, answer and translation stages around a model provider.

Each document runs its own little state machine inside mapInPandas; a failing document gives an error status and no
rows, never a failed job. Write the result once and read it back: a provider may answer differently when asked again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.schemas import BROAD_OPENINGS, DOCUMENT_PHRASES, GENERATION_CHARS, REVIEW_CHARS, SAMPLE_RESULT, TARGET_LANGUAGES


class ModelProvider(Protocol):
    """Verdicts are dicts with approved and reason; a pair has question, answer, supporting_text, question_type."""

    def generate(self, context: str, previous: dict | None, feedback: str) -> dict: ...

    def check_language(self, question: str, answer: str) -> dict: ...

    def check_faithful(self, context: str, pair: dict) -> dict: ...

    def check_quality(self, context: str, pair: dict) -> dict: ...

    def translate(self, context: str, pair: dict, language: str, feedback: str) -> dict: ...

    def check_translation(self, context: str, pair: dict, translated: dict, language: str) -> dict: ...


class OfflineProvider:
    """A deterministic provider: asks about a text's first sentences and marks translations with their language."""

    def generate(self, context: str, previous: dict | None, feedback: str) -> dict:
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", context.strip()) if len(s.split()) >= 3] or [context.strip()]
        answer = sentences[1 if previous and len(sentences) > 1 else 0]
        topic = " ".join(re.sub(r"[^\w\s]", "", answer).split()[:6])
        return {"question": f"How does the text explain {topic.lower()}?", "answer": answer, "supporting_text": answer, "question_type": "other"}

    def check_language(self, question: str, answer: str) -> dict:
        latin = sum(c.isascii() for c in question + answer) >= 0.8 * len(question + answer)
        return {"approved": latin, "reason": "" if latin else "not written in Latin letters"}

    def check_faithful(self, context: str, pair: dict) -> dict:
        found = bool(pair["supporting_text"]) and pair["supporting_text"] in context
        return {"approved": found, "reason": "" if found else "supporting text not in context"}

    def check_quality(self, context: str, pair: dict) -> dict:
        question = pair["question"].lower()
        poor = any(p in question for p in DOCUMENT_PHRASES) or any(question.startswith(p) for p in BROAD_OPENINGS)
        return {"approved": not poor, "reason": "weak-query-shape" if poor else ""}

    def translate(self, context: str, pair: dict, language: str, feedback: str) -> dict:
        return {"question": f"[{language}] {pair['question']}", "answer": f"[{language}] {pair['answer']}"}

    def check_translation(self, context: str, pair: dict, translated: dict, language: str) -> dict:
        good = translated["question"].startswith(f"[{language}]")
        return {"approved": good, "reason": "" if good else "wrong language"}


def _english(provider: ModelProvider, context: str, attempts: int) -> tuple[dict | None, str]:
    pair, feedback, failure = None, "", ""
    checks: list[tuple[str, Callable[[dict], dict]]] = [
        ("language check failed", lambda p: provider.check_language(p["question"], p["answer"])),
        ("faithfulness failed", lambda p: provider.check_faithful(context[:REVIEW_CHARS], p)),
        ("question quality failed", lambda p: provider.check_quality(context[:REVIEW_CHARS], p)),
    ]
    for _ in range(attempts):
        pair = {"question": "", "answer": "", "supporting_text": "", "question_type": "other"} | provider.generate(context[:GENERATION_CHARS], pair, feedback)
        for name, check in checks:
            verdict = check(pair)
            if not verdict["approved"]:
                failure = feedback = f"{name}: {verdict.get('reason') or 'rejected'}"
                break
        else:
            return pair, ""
    return None, failure or "validation failed"


def _translations(provider: ModelProvider, context: str, pair: dict, languages: list[str], attempts: int) -> tuple[dict, list[str]]:
    done, failed = {}, []
    for language in languages:
        feedback = ""
        for _ in range(attempts):
            translated = provider.translate(context[:REVIEW_CHARS], pair, language, feedback)
            verdict = provider.check_translation(context[:REVIEW_CHARS], pair, translated, language)
            if verdict["approved"]:
                done[language] = translated
                break
            feedback = verdict.get("feedback") or verdict.get("reason") or "not fluent or faithful enough"
        else:
            failed.append(f"{language} (translation quality failed: {feedback})")
    return done, failed


def process_document(provider: ModelProvider, corpus_id: str, context: str, languages: list[str], attempts: int) -> tuple[list[dict], str]:
    """Rows and status of one document."""
    if not context or not context.strip():
        return [], "skipped (empty context)"
    try:
        pair, failure = _english(provider, context, attempts)
        if pair is None:
            return [], f"skipped ({failure})"
        done, failed = _translations(provider, context, pair, languages, attempts)
    except Exception as problem:  # one document's failure must not end the others
        return [], f"error: {problem}"
    found = {"en": pair} | done
    rows = [{"corpus_id": corpus_id, "language": k, "question": v["question"], "answer": v["answer"]} for k, v in found.items()]
    skipped = f", skipped {len(failed)}: {', '.join(failed)}" if failed else ""
    return rows, f"ok ({pair['question_type'] or 'validated'} en + {len(done)} translations{skipped})"


def generate(sample: DataFrame, provider: Callable[[], ModelProvider] = OfflineProvider, languages: list[str] | None = None, attempts: int = 3) -> DataFrame:
    """index, corpus_id, rows, status for sample's index, id, context, title; provider makes one provider a task."""
    languages = TARGET_LANGUAGES if languages is None else languages
    provider()  # a missing key or setting shows on the driver, before any task runs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            done = [process_document(model, r.id, r.text, languages, attempts) for r in batch.itertuples()]
            yield pd.DataFrame({"index": batch["index"], "corpus_id": batch["id"], "rows": [d[0] for d in done], "status": [d[1] for d in done]})

    text = F.when(F.coalesce("context", F.lit("")) == "", F.coalesce("title", F.lit(""))).otherwise(F.col("context"))
    rows = sample.select("index", F.col("id"), text.alias("text"))
    return rows.repartition(sample.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, SAMPLE_RESULT)


def statuses(results: DataFrame) -> DataFrame:
    """corpus_id, status and how many rows it gave, of each document in the order of the sample."""
    return results.select("index", "corpus_id", "status", F.size("rows").alias("pairs")).orderBy("index").drop("index")


def language_counts(results: DataFrame) -> DataFrame:
    """language, pairs: what the whole run gave."""
    return results.select(F.explode("rows").alias("row")).groupBy("row.language").agg(F.count(F.lit(1)).alias("pairs"))


def template_questions(entities: DataFrame, templates: list[str]) -> DataFrame:
    """corpus_id, entity, question: each template, with {} for the entity, of each of entities (corpus_id, entity)."""
    filled = F.transform(F.array(*map(F.lit, templates)), lambda t: F.replace(t, F.lit("{}"), F.col("entity")))
    return entities.filter(F.coalesce(F.trim("entity"), F.lit("")) != "").select("corpus_id", "entity", F.explode(filled).alias("question"))


def pairs(results: DataFrame) -> DataFrame:
    """corpus_id, language, question, answer in the order of the sample, English first."""
    return results.select("index", F.posexplode("rows").alias("place", "row")).orderBy("index", "place").select("row.*")

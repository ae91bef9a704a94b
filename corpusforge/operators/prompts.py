"""A model provider over any text completion: prompts for each stage, and what its answers mean.

complete(prompt) -> answer is all that a service has to offer; answers are JSON objects, with or without a code fence.
What is missing in an answer has a stated default; an answer that isn't JSON raises, which ends its document only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from corpusforge.schemas import (
    BROAD_OPENINGS, DOCUMENT_PHRASES, GENERATION_CHARS, LANGUAGE_NAMES, QUESTION_FAILURES, QUESTION_TYPES, REVIEW_CHARS, SEVERITIES, TRANSLATION_FAILURES,
)

#: What a translation is judged by; a missing one of the second group counts as fine, one of the first as failed.
STRICT = ("language_ok", "meaning_ok", "technical_ok", "specificity_ok", "fluency_ok")
LENIENT = ("terminology_ok", "artifact_ok", "grammar_ok")


def parse(answer: str) -> dict:
    body = answer.strip()
    if body.startswith("```"):
        body = body.partition("\n")[2].rpartition("```")[0]
    found = json.loads(body)
    if not isinstance(found, dict):
        raise ValueError("the answer is not a JSON object")
    return found


def stated(value: object) -> str:
    return "" if value is None else str(value).strip()


def quality_reason(verdict: dict) -> str:
    """Failure type, reason and better direction in one line."""
    reason, failure, better = (stated(verdict.get(k)) for k in ("reason", "failure_type", "better_direction"))
    if failure not in ("", "none"):
        reason = f"{failure}: {reason}" if reason else failure
    return f"{reason} Better direction: {better}".strip() if better else reason


def translation_feedback(verdict: dict) -> str:
    """What a translator is told before another attempt."""
    parts = (("Failure type", "failure_type"), ("Reason", "reason"), ("Better direction", "better_direction"))
    told = [(name, stated(verdict.get(key))) for name, key in parts]
    return " ".join(f"{name}: {value}." for name, value in told if value and (name, value) != ("Failure type", "none"))


def translation_verdict(answer: dict) -> dict:
    """The judge's flags with their defaults, and whether they approve: all but grammar and fluency must hold, and these two
    unless the severity is low."""
    flags = {k: bool(answer.get(k, False)) for k in STRICT} | {k: bool(answer.get(k, True)) for k in LENIENT}
    severity, failure = stated(answer.get("severity")).lower(), stated(answer.get("failure_type", "none")).lower() or "none"
    severity = severity if severity in SEVERITIES else "high"
    failure = failure if failure in TRANSLATION_FAILURES else "meaning-error"
    tongue = flags["grammar_ok"] and flags["fluency_ok"]
    approved = all(v for k, v in flags.items() if k not in ("grammar_ok", "fluency_ok")) and (tongue or severity == "low")
    verdict = flags | {"severity": severity, "failure_type": failure, "approved": approved, "retry_recommended": not approved}
    verdict |= {k: stated(answer.get(k)) for k in ("reason", "better_direction")}
    return verdict | {"feedback": translation_feedback(verdict)}


def _prompt(task: str, rules: list[str], shape: str, /, **given: str) -> str:
    parts = [task, *[f"- {r}" for r in rules], f"Answer with one JSON object: {shape}"]
    return "\n".join(parts) + "".join(f"\n\n{name.replace('_', ' ').title()}:\n{text}" for name, text in given.items() if text)


class PromptedProvider:
    """A ModelProvider; complete gets a prompt and gives the model's answer. Stages may have models of their own."""

    def __init__(self, complete: Callable[[str], str], check: Callable[[str], str] | None = None, translator: Callable[[str], str] | None = None):
        self.complete, self.judge, self.translator = complete, check or complete, translator or complete

    def generate(self, context: str, previous: dict | None, feedback: str) -> dict:
        rules = [
            "Write in English, whatever the text's language; ask what somebody searching for this knowledge would ask.",
            "The question must make sense without the text and must not copy its title or wording.",
            "Ask for one specific fact; the answer is short and rests on one passage, which is given word for word.",
            "Never use: " + "; ".join(DOCUMENT_PHRASES) + ".",
            "Don't begin with: " + "; ".join(BROAD_OPENINGS) + ".",
            "The question type is one of: " + ", ".join(QUESTION_TYPES) + ".",
        ]
        before = f"{previous['question']}\n{previous['answer']}" if previous else ""
        shape = '{"question": "", "answer": "", "supporting_text": "", "question_type": ""}'
        given = {"text": context[:GENERATION_CHARS], "rejected_attempt": before, "why_it_was_rejected": feedback}
        found = parse(self.complete(_prompt("Write one question and answer about a chemistry text for a retrieval test.", rules, shape, **given)))
        kept = {k: stated(found.get(k)) for k in ("question", "answer", "supporting_text")}
        return kept | {"question_type": stated(found.get("question_type")) or "other"}

    def _verdict(self, task: str, rules: list[str], /, **given: str) -> dict:
        found = parse(self.judge(_prompt(task, rules, '{"approved": true, "reason": ""}', **given)))
        return {"approved": bool(found.get("approved", False)), "reason": stated(found.get("reason"))}

    def check_language(self, question: str, answer: str) -> dict:
        rules = ["Names, formulas and units of other languages are fine.", "Reject text that is mixed, garbled or not fluent."]
        return self._verdict("Are this question and this answer written in correct English?", rules, question=question, answer=answer)

    def check_faithful(self, context: str, pair: dict) -> dict:
        rules = ["The passage must stand in the text.", "The answer must follow from it and answer the whole question.", "Reject anything the text doesn't say."]
        given = {"text": context[:REVIEW_CHARS], "question": pair["question"], "answer": pair["answer"], "passage": pair["supporting_text"]}
        return self._verdict("Does the text support this answer?", rules, **given)

    def check_quality(self, context: str, pair: dict) -> dict:
        rules = [
            "A good question stands alone, is specific, and shares few words with the text.",
            "Reject questions about the document itself: " + "; ".join(DOCUMENT_PHRASES) + ".",
            "Reject broad templates such as: " + "; ".join(BROAD_OPENINGS) + ".",
            "The failure type is none or one of: " + ", ".join(QUESTION_FAILURES) + ".",
        ]
        shape = '{"approved": true, "failure_type": "none", "reason": "", "better_direction": ""}'
        given = {"text": context[:REVIEW_CHARS], "question": pair["question"], "answer": pair["answer"]}
        found = parse(self.judge(_prompt("Is this a good question for a retrieval test?", rules, shape, **given)))
        return {"approved": bool(found.get("approved", False)), "reason": quality_reason(found)}

    def translate(self, context: str, pair: dict, language: str, feedback: str) -> dict:
        name = LANGUAGE_NAMES.get(language, language)
        rules = [
            f"Write natural {name}, as an expert would; keep every technical detail, number and name.",
            "No alternatives with slashes, no English in parentheses, no letters of another script.",
        ]
        given = {"text_for_reference": context[:REVIEW_CHARS], "question": pair["question"], "answer": pair["answer"], "why_the_last_attempt_was_rejected": feedback}
        shape = f'{{"translations": {{"{language}": {{"question": "", "answer": ""}}}}}}'
        found = parse(self.translator(_prompt(f"Translate this question and answer into {name}.", rules, shape, **given)))
        found = found.get("translations", found).get(language)
        if not isinstance(found, dict):
            raise ValueError(f"no translation into {language}")
        return {k: stated(found.get(k)) for k in ("question", "answer")}

    def check_translation(self, context: str, pair: dict, translated: dict, language: str) -> dict:
        name = LANGUAGE_NAMES.get(language, language)
        rules = [
            "Judge language, meaning, technical detail, specificity, terminology, artifacts, fluency and grammar one by one.",
            "Severity is one of: " + ", ".join(SEVERITIES) + ". The failure type is one of: " + ", ".join(TRANSLATION_FAILURES) + ".",
        ]
        shape = "{" + ", ".join(f'"{k}": true' for k in (*STRICT, *LENIENT)) + ', "severity": "low", "failure_type": "none", "reason": "", "better_direction": ""}'
        given = {"text": context[:REVIEW_CHARS], "question": pair["question"], "answer": pair["answer"], "translated_question": translated["question"], "translated_answer": translated["answer"]}
        return translation_verdict(parse(self.judge(_prompt(f"Is this a good translation into {name}?", rules, shape, **given))))

    def check_relevance(self, context: str, pair: dict) -> dict:
        """Whether the text answers the question at all; a check of finished pairs."""
        given = {"text": context[:REVIEW_CHARS], "question": pair["question"], "answer": pair["answer"]}
        return self._verdict("Does the text entail this answer to this question?", ["Judge entailment, not style."], **given)

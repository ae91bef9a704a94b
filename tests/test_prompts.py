"""The prompted provider, and its policies against the Columns of the same rules."""

import json

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import policy
from corpusforge.operators import generation, prompts
from corpusforge.plans import fixtures

CONTEXT = "A catalyst works at 20 degrees. It is made of iron."
GOOD = {"question": "At which temperature does the catalyst work?", "answer": "At 20 degrees", "supporting_text": "A catalyst works at 20 degrees."}


class Service:
    """Answers by the first word that a prompt has; remembers the prompts."""

    def __init__(self, **answers):
        self.answers, self.seen = answers, []

    def __call__(self, prompt):
        self.seen.append(prompt)
        answer = next(v for k, v in self.answers.items() if prompt.startswith(k))
        answer = answer.pop(0) if isinstance(answer, list) else answer
        return answer if isinstance(answer, str) else "```json\n" + json.dumps(answer) + "\n```"


def approving(**answers):
    fine = {"approved": True}
    flags = {k: True for k in (*prompts.STRICT, *prompts.LENIENT)} | {"severity": "low"}
    translation = {"translations": {"de": {"question": "Frage?", "answer": "Antwort"}}}
    return Service(**({"Write": GOOD, "Are": fine, "Does": fine, "Is this a good q": fine, "Translate": translation, "Is this a good t": flags} | answers))


def test_a_document_through_the_stages():
    service = approving()
    rows, status = generation.process_document(prompts.PromptedProvider(service), "d", CONTEXT, ["de"], 3)
    assert [(r["language"], r["question"]) for r in rows] == [("en", GOOD["question"]), ("de", "Frage?")] and status == "ok (other en + 1 translations)"
    assert len(service.seen) == 6 and all(CONTEXT in p for p in service.seen if not p.startswith("Are"))


def test_feedback_reaches_the_next_attempt():
    judged = [{"approved": False, "failure_type": "title-lift", "reason": "same words", "better_direction": "ask why"}, {"approved": True}]
    bad = {k: True for k in (*prompts.STRICT, *prompts.LENIENT)} | {"grammar_ok": False, "severity": "Medium", "failure_type": "grammar-morphology", "reason": "wrong case"}
    service = approving(**{"Is this a good q": judged, "Is this a good t": [bad, bad | {"severity": "low"}]})
    rows, status = generation.process_document(prompts.PromptedProvider(service), "d", CONTEXT, ["de"], 3)
    assert len(rows) == 2 and status.startswith("ok")
    writes, translations = ([p for p in service.seen if p.startswith(s)] for s in ("Write", "Translate"))
    assert "question quality failed: title-lift: same words Better direction: ask why" in writes[1] and GOOD["question"] in writes[1]
    assert "Failure type: grammar-morphology. Reason: wrong case." in translations[1]


def test_answers_that_are_not_json_end_their_document():
    for answers in ({"Write": "no"}, {"Translate": {"translations": {}}}, {"Does": "[1]"}):
        rows, status = generation.process_document(prompts.PromptedProvider(approving(**answers)), "d", CONTEXT, ["de"], 3)
        assert rows == [] and status.startswith("error: ")
    assert prompts.PromptedProvider(approving(Does={"reason": "x"})).check_relevance(CONTEXT, GOOD) == {"approved": False, "reason": "x"}


def test_policies_agree_with_the_columns(spark):
    rows = fixtures.verdicts(spark, "").withColumns({"reason": F.when(F.col("k") % 3 == 0, " too broad "), "better_direction": F.when(F.col("k") % 2 == 0, "ask why")})
    v = {c: F.col(c) for c in rows.columns if c.endswith("_ok") or c == "severity"}
    told = [F.col(c) for c in ("reason", "failure_type", "better_direction")]
    found = rows.select(
        "*", policy.translation_approved(v).alias("approved"), policy.severity_of(F.col("severity")).alias("s"), policy.failure_of(F.col("failure_type")).alias("f"),
        policy.reason_format(*told).alias("formatted"), policy.retry_feedback(F.col("reason"), policy.failure_of(F.col("failure_type")), F.col("better_direction")).alias("feedback"),
    ).collect()
    for r in found:
        mine = prompts.translation_verdict(r.asDict())
        assert (mine["approved"], mine["severity"], mine["failure_type"], mine["feedback"]) == (r.approved, r.s, r.f, r.feedback)
        assert prompts.quality_reason(r.asDict()) == r.formatted
    assert prompts.translation_verdict({})["approved"] is False


def test_each_document_has_a_status(spark):
    sample = spark.createDataFrame([(0, "a", CONTEXT, "t"), (1, "b", "", "")], "index long, id string, context string, title string")
    results = generation.generate(sample, languages=["de"])
    assert [tuple(r) for r in generation.statuses(results).collect()] == [("a", "ok (other en + 1 translations)", 2), ("b", "skipped (empty context)", 0)]
    assert sorted(map(tuple, generation.language_counts(results).collect())) == [("de", 1), ("en", 1)]


@pytest.mark.parametrize("answer", ['{"a": 1}', '```\n{"a": 1}\n```', '  ```json\n{"a": 1}```'])
def test_fences(answer):
    assert prompts.parse(answer) == {"a": 1}

"""Expected values are derived by hand from the rules of the functions."""

import pytest
from pyspark.sql import functions as F

from corpusforge.functions import localized, policy, text

CLEAN = [(None, ""), ("a&nbsp;b", "a b"), ("&amp;lt;", "&lt;"), ("a\x1c\x85　b ", "a b"), ("", "")]
CLAIMS = [
    ("1. A thing. 2. The thing", "A thing."),
    ("1. 1,2-dichloro", ",2-dichloro"),
    ("10 mg of X", "0 mg of X"),
    ("1. at least 2 - 3 mg", "at least"),
]
MARKUP = [
    ("<claim-statement>W</claim-statement><claim id=1>1. X</claim>", "W 1. X"),
    ('<claim>1. A<chemistry id="c">zz</chemistry>B</claim>', "A B"),
    ("no claim", ""),
]
CUTS = [("ab cd ef", "ab"), ("abcdefgh", "abcde"), ("abcde", "abcde")]


def values(spark, pairs, f):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "pairs, f",
    [(CLEAN, text.clean_text), (CLAIMS, text.claim_from_text), (MARKUP, text.claim_from_html), (CUTS, lambda c: text.truncate(c, 5))],
)
def test_text(spark, pairs, f):
    assert values(spark, pairs, f) == [b for _, b in pairs]


def test_entities_without_semicolon(spark):
    pairs = [
        (None, "", ""),
        ("ver&amp</b> &am &amp;&amp", "ver&</b> &am &&", "ver&amp</b> &am &&amp"),
        ("&ampx; &nosuch; &;", "&x; &nosuch; &;", "&ampx; &nosuch; &;"),
        ("&lt;&#39;&#x41;&#66 &amp;quot;", "<'AB &quot;", "<'A&#66 &quot;"),
    ]
    assert values(spark, [(a, b) for a, b, _ in pairs], text.clean_text) == [b for _, b, _ in pairs]
    assert values(spark, [(a, c) for a, _, c in pairs], lambda c: text.clean_text(c, bare=False)) == [c for *_, c in pairs]


def test_words(spark):
    pairs = [(None, 0), ("  ", 0), ("日本語の文。", 1), ("a b", 2)]
    assert values(spark, pairs, lambda c: text.word_count(text.clean_text(c))) == [b for _, b in pairs]


def test_localized(spark):
    schema = "a array<struct<text:string,language:string>>, t array<struct<text:string,language:string>>"
    entries = [(" ", "EN"), ("x ", "en")]
    rows = spark.createDataFrame([(entries, [("x", "DE"), ("", "de"), (None, "de")]), (None, None)], schema)
    found = rows.select(
        localized.pick_text("a", F.lit("en")).alias("p"), localized.languages_present(["de"], "t", "t").alias("l"), localized.has_text("a").alias("h")
    ).collect()
    assert [(r.p, r.l, r.h) for r in found] == [("x", ["de"], True), (None, [], False)]


def test_class_prefix_of_nulls(spark):
    rows = spark.createDataFrame([([("C07",)],), ([(None,), ("H01",)],), (None,)], "cpc array<struct<code:string>>")
    assert [r[0] for r in rows.select(localized.class_prefix("cpc", ["C"])).collect()] == [True, False, False]


def test_policy(spark):
    reasons = spark.createDataFrame([("r", "high-overlap", "d"), ("", "none", "d")], "r string, f string, b string")
    found = reasons.select(policy.reason_format(F.col("r"), F.col("f"), F.col("b"))).collect()
    assert [r[0] for r in found] == ["high-overlap: r Better direction: d", "Better direction: d"]
    fenced = spark.createDataFrame([('```json\n{"approved": true}\n```',)], "x string")
    assert fenced.select(policy.parse_json(F.col("x"), "approved boolean")["approved"]).first()[0] is True

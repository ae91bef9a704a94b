import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import corpus, generation, packaging, quality, sampling, selection
from corpusforge.schemas import PUBLICATIONS
from corpusforge.sources import files


def pubs(spark, rows):
    entry = lambda texts: [(t, l, None) for t, l in texts]  # noqa: E731, E741
    full = [(n, "f", "DE", d, entry(t), entry(a), None, None, entry(c), None, [("C07", None, None, None)], None) for n, d, t, a, c in rows]
    return files.with_order(spark.createDataFrame(full, PUBLICATIONS))


LONG = " ".join(["words"] * 60)


def test_short_first_record_hides_a_later_one(spark):
    rows = pubs(spark, [("A", 20240102, [("t", "en")], [("short", "en")], []), ("A", 20240101, [("t", "en")], [(LONG, "en")], [])])
    assert corpus.preprocess(rows).count() == 0


def test_corpus_and_merge(spark):
    rows = pubs(spark, [("A", 20240102, [("T&amp;T", "EN")], [(LONG, "en")], [("1. X thing. 2. More", "en")]), (None, 0, [("u", "de")], [(LONG, "de")], [])])
    built = corpus.preprocess(rows)
    found = {r.id: r for r in corpus.in_output_order(corpus.merge(built)).collect()}
    assert found["A_en"].context == f"Title: T&T Abstract: {LONG} First claim: X thing."
    assert (found["_de"].publication_date, found["_de"].description, found["A_en"].first_claim) == ("", "", "X thing.")


def test_selection(spark):
    rows = pubs(spark, [(f"P{i}", 20240101 + i, [("t", "en")], [(LONG, "en")], []) for i in range(6)])
    assert [r.publication_number for r in selection.top_n_per_language(rows, 2).collect()] == ["P5", "P4"]
    assert [r.publication_number for r in selection.select_publications(rows, primary_lang="en", limit=1).collect()] == ["P5"]
    with pytest.raises(ValueError):
        selection.select_publications(rows, use_classification=False)
    plan = selection.top_n_per_language(rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert [selection.fetch_size(n) for n in (1, 40, 44, 100)] == [11, 50, 55, 125]


def test_stratified_sample_is_never_filled_up(spark):
    counts = {"en": 620, "fr": 145, "de": 129, "es": 106}
    rows = spark.createDataFrame([(f"{k}{i}", k) for k, n in counts.items() for i in range(n)], "id string, language string")
    found = dict(sampling.stratified_sample(rows, 50).groupBy("language").count().collect())
    assert found == {"en": 31, "fr": 7, "de": 6, "es": 5}
    assert sampling.stratified_sample(rows, 5000).count() == 1000


def test_query_ids(spark):
    qac = spark.createDataFrame([(i, c, l, "q", "a") for i, (c, l) in enumerate([("a", "en"), ("a", "en"), ("zz", "en"), ("zz", "en"), ("a", "de")])], "i long, corpus_id string, language string, question string, answer string")
    docs = spark.createDataFrame([("a", "c", "en", 1), (" a ", "last", "en", 2)], "id string, context string, language string, ord int")
    ids = [r.query_id for r in packaging.identified(qac, docs).orderBy("i").collect()]
    assert ids == ["a_q_en", "a_q_en_1", "q_2_en", "q_3_en", "a_q_de"]
    flat = packaging.flat_export(qac, docs)
    assert {r.corpus for r in flat.collect()} == {"last", ""} and packaging.export_counts(flat).first() == (5, 2)


def test_generation_isolates_failures(spark):
    class Failing(generation.OfflineProvider):
        def check_translation(self, context, pair, translated, language):
            if "boom" in context:
                raise RuntimeError("no service")
            return {"approved": language != "fr", "reason": "stiff"}

    rows = spark.createDataFrame([(0, "a", "A longer sentence here. Another one follows.", ""), (1, "b", "A boom sentence here.", ""), (2, "c", " ", "")], "index long, id string, context string, title string")
    found = {r["index"]: r for r in generation.generate(rows, Failing, ["de", "fr"]).collect()}
    assert [r.language for r in found[0].rows] == ["en", "de"] and "skipped 1: fr" in found[0].status
    assert found[1].rows == [] and found[1].status == "error: no service"
    assert found[2].status == "skipped (empty context)"


def test_csv_keeps_quotes_and_lines(spark, tmp_path):
    row = ('say "hi"\nthere ', "en", "", "")
    files.write_csv(spark.createDataFrame([row], "corpus_id string, language string, question string, answer string"), str(tmp_path / "q"))
    assert tuple(files.read_qac(spark, str(tmp_path / "q")).first()) == row


def test_stream(spark, tmp_path):
    from corpusforge.streaming import ingest

    source = pubs(spark, [("A", 20240102, [("t", "en")], [(LONG, "en")], [])])
    source.withColumn("ord", F.col("ord").cast("long")).write.json(str(tmp_path / "in"))
    for _ in range(2):
        stream = ingest.write_new_rows(ingest.read_new_publications(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        stream.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_short_answers_in_context(spark):
    docs = [(1, "Take aspirin daily, or the red\tpill of old  times"), (2, "aspirins and the red pills"), (3, ""), (4, None), (5, "one two three four five six seven eight ninety"), (6, " the red pill")]
    items = [(1, "aspirin"), (2, "red pill"), (3, "the red pill"), (4, "red\tpill of"), (5, "one two three four five six seven eight nine"), (6, ""), (7, None), (8, " red "), (9, "absent"), (10, "the red pill of old"), (11, "wo three four five six")]
    found = quality.answers_in_context(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    expected = [(i, d) for i, a in items for d, t in docs if a is not None and t is not None and a in t]
    assert sorted(map(tuple, found.collect())) == expected


def test_first_claim_of_every_page(spark):
    import html
    import re

    import __spark_entry__

    sf = "/root/testdata/sf0.01"
    found = {r.page_id: r.claim for r in __spark_entry__.queries()["q_first_claim_html_all"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()

    def claim(page):
        block = re.search(r"<claim\b[^>]*>(.*?)</claim>", page.replace("<p>", "<claim>").replace("</p>", "</claim>"), re.S | re.I)
        text = block.group(1) if block else ""
        for pattern in (r"(?is)<chemistry\b.*?</chemistry>", r"(?i)</?claim-text\b[^>]*>", r"<[^>]+>"):
            text = re.sub(pattern, " ", text)
        return re.sub(r"^\s*1\s*[\.\):\-]*\s*", "", re.sub(r"\s+", " ", html.unescape(text)).strip()).strip()

    assert found == {p.page_id: claim(p.html) for p in pages} and len(found) == len(pages)
    assert any("&" in c for c in found.values())


def test_near_vectors_in_tiles(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    v[50:60] = v[0] + rng.normal(0, 0.05, (10, 8))
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(900, [0.0] * 8, 1), (901, None, 1), (902, [1.0, 2.0], 1)]
    found = {r.vec_id: (r.links, r.smallest) for r in quality.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.9, tile=70).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    expected = {i: (int(near[i].sum()) - 1, int(np.flatnonzero(near[i])[0])) for i in range(300)}
    assert found == expected | {902: (0, 902)} and found[55][0] >= 10


def test_minhash_near(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices([f"w{k}" for k in range(400)], k=120))) for i in range(60)]
    texts += [(100 + i, t.replace(t.split()[60], "changed")) for i, t in texts[:20]] + [(200, ""), (201, None), (202, texts[0][1])]
    found = {r.doc_id: r.near_id for r in quality.minhash_near(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = {}
    for d, t in texts:
        words = " ".join((t or "").lower().split()).split(" ")
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    expected = {}
    for d in sets:
        for e in sorted(sets):
            if e < d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                expected[d] = e
                break
    assert found == expected and len(expected) > 15

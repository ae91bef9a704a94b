"""The command line from a dump to the packaged tables."""

import pytest
from pyspark.sql import functions as F

from corpusforge import cli
from corpusforge.operators import generation
from corpusforge.schemas import PUBLICATIONS
from corpusforge.sources import files

LONG = "A catalyst was found that works at low temperature. " + "It holds many words of a text. " * 12


class Half(generation.OfflineProvider):
    def translate(self, context, pair, language, feedback):
        if language == "fr":
            raise RuntimeError("no service")
        return super().translate(context, pair, language, feedback)


@pytest.fixture
def dump(spark, tmp_path):
    entry = lambda t, language: [(t, language, None)]
    rows = []
    for i in range(12):
        code = [("C07" if i % 3 else "H01", None, None, None)]
        title, abstract = f'Thing "{i}", new\nline', f"Number {i}. {LONG}"
        claims = entry("1. A thing. 2. More", "en") if i % 2 else None
        rows.append((f"P{i}", "f", ["DE", "FR"][i % 2], 20240101 + i, entry(title, "en"), entry(abstract, "en"), None, None, claims, None, code, None))
    spark.createDataFrame(rows, PUBLICATIONS).repartition(3).write.json(f"{tmp_path}/dump")
    spark.createDataFrame([("P0",), ("P0",)], "publication_number string").write.parquet(f"{tmp_path}/match")
    return tmp_path


def run(spark, *args):
    cli.run(spark, cli.parser().parse_args([str(a) for a in args]))


def ids(spark, path):
    return sorted(r.publication_number for r in files.read_corpus(spark, str(path)).collect())


def test_selection_options(spark, dump):
    chemical = sorted(f"P{i}" for i in range(12) if i % 3)
    for options, expected in {
        (): chemical,
        ("--everything",): sorted(f"P{i}" for i in range(12)),
        ("--match", dump / "match"): sorted([*chemical, "P0"]),
        ("--match", dump / "match", "--no-classes"): ["P0"],
        ("--cpc", "H01", "--ipc", "H01"): sorted(f"P{i}" for i in range(0, 12, 3)),
        ("--countries", "FR", "--start-date", "20240103", "--end-date", "20240106"): ["P5"],
        ("--claim",): [p for p in chemical if int(p[1:]) % 2],
        ("--primary", "de"): [],
        ("--multilingual", 2): [],
        ("--limit", 3): ["P10", "P11", "P8"],
    }.items():
        stats = () if options else ("--stats", dump / "stats")
        run(spark, "corpus", dump / "dump", dump / "out", *stats, *options)
        assert ids(spark, dump / "out") == expected, options
    counted = spark.read.csv(str(dump / "stats"), header=True).collect()
    assert [r.language for r in counted] == ["en"]


def test_all_steps(spark, dump):
    run(spark, "all", dump / "dump", dump / "run", "--sample", 5, "--targets", "de,fr", "--attempts", 1, "--provider", f"{__name__}:Half")
    statuses = spark.read.csv(str(dump / "run/status"), header=True).collect()
    assert len(statuses) == 5 and all(r.status == "error: no service" and r.pairs == "0" for r in statuses)
    run(spark, "all", dump / "dump", dump / "run", "--sample", 5, "--targets", "de")
    assert spark.read.csv(str(dump / "run/status"), header=True).filter("status = 'ok (other en + 1 translations)' AND pairs = 2").count() == 5
    queries = spark.read.parquet(str(dump / "run/package/data/queries"))
    assert queries.count() == 10 and queries.filter(F.col("_id").rlike("^P[0-9]+_en_q_(en|de)$")).count() == 10
    assert spark.read.parquet(str(dump / "run/package/data/qrels")).columns == ["query-id", "corpus-id", "score"]
    flat = files._read_csv(spark, str(dump / "run/flat"), "question string, answer string, corpus string, question_lang string, source_lang string")
    assert flat.count() == 10 and flat.filter("corpus LIKE 'Title: Thing \"%' AND source_lang = 'en'").count() == 10


def test_dense_index(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("corpus_id"), *[F.lit(f'a "b",\n{c}').alias(c) for c in ("language", "question", "answer")])
    files.write_csv(rows.repartitionByRange(7, F.col("corpus_id").cast("int")), str(tmp_path / "qac"))
    found = files.dense_index(files.read_qac(spark, str(tmp_path / "qac"))).collect()
    assert sorted((r.i, int(r.corpus_id)) for r in found) == [(i, i) for i in range(1000)]


def test_credential(spark, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "x")
    assert files.credential(spark, "SOME_KEY") == "x"
    with pytest.raises(ValueError):
        files.credential(spark, "NO_SUCH_KEY")

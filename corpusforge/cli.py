"""Command line, without questions asked.

python -m corpusforge.cli corpus DUMP OUT [--form json|parquet|bigquery] [--limit N] [--languages en,de] [selection]
python -m corpusforge.cli qa CORPUS OUT [--sample 50] [--languages de,fr] [--attempts 3] [--provider module:factory]
python -m corpusforge.cli package CORPUS QAC OUT
python -m corpusforge.cli flat CORPUS QAC OUT
python -m corpusforge.cli all DUMP OUT, with the options of corpus and qa: OUT/corpus, OUT/qac, OUT/status, OUT/package, OUT/flat

Selection: --match TABLE (Parquet with publication_number), --cpc A,B, --ipc A,B, --no-classes, --start-date, --end-date,
--countries DE,FR, --primary LANGUAGE, --multilingual N, --claim; or --everything, which takes all publications.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusforge.operators import corpus, generation, packaging, sampling, selection
from corpusforge.schemas import LANGUAGES, MIN_WORDS, TARGET_LANGUAGES
from corpusforge.sources import files

SEED = 42


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusforge")
    steps = top.add_subparsers(dest="step", required=True)
    listed = lambda x: x.split(",")
    places = {"corpus": ["dump", "out"], "qa": ["corpus", "out"], "package": ["corpus", "qac", "out"], "flat": ["corpus", "qac", "out"], "all": ["dump", "out"]}
    for name, named in places.items():
        step = steps.add_parser(name)
        for place in named:
            step.add_argument(place)
        if name in ("corpus", "all"):
            step.add_argument("--form", choices=["json", "parquet", "bigquery"], default="json")
            step.add_argument("--limit", type=int, default=0)
            step.add_argument("--languages", type=listed, default=LANGUAGES)
            step.add_argument("--min-words", type=int, default=MIN_WORDS)
            step.add_argument("--stats")
            step.add_argument("--match")
            for flag in ("--cpc", "--ipc", "--countries"):
                step.add_argument(flag, type=listed)
            for flag in ("--start-date", "--end-date"):
                step.add_argument(flag, type=int)
            step.add_argument("--primary")
            step.add_argument("--multilingual", type=int, default=0)
            for flag in ("--no-classes", "--everything", "--claim"):
                step.add_argument(flag, action="store_true")
        if name in ("qa", "all"):
            step.add_argument("--sample", type=int, default=50)
            step.add_argument("--targets" if name == "all" else "--languages", dest="targets", type=listed, default=TARGET_LANGUAGES)
            step.add_argument("--attempts", type=int, default=3)
            step.add_argument("--provider")
            step.add_argument("--status")
    return top


def selected(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The publications that the options ask for, with ord."""
    pubs = files.read_publications(spark, args.dump, args.form)
    if args.everything:
        return files.with_order(pubs)
    common = {
        "match": spark.read.parquet(args.match) if args.match else None, "cpc_prefixes": args.cpc, "ipc_prefixes": args.ipc, "use_classification": not args.no_classes,
        "start_date": args.start_date, "end_date": args.end_date, "country_codes": args.countries,
    }
    if args.limit and not args.primary:
        chosen = selection.top_n_per_language(
            pubs, selection.fetch_size(args.limit), languages=args.languages, min_abstract_words=args.min_words, require_claim=args.claim, **common
        )
    else:
        chosen = selection.select_publications(
            pubs, languages=args.languages, primary_lang=args.primary, min_primary_abstract_words=args.min_words if args.primary else None,
            require_primary_claim=args.claim, require_any_claim=args.claim, require_multilingual=args.multilingual > 0, min_language_count=args.multilingual, **common,
        ).drop("languages_present")
    return files.with_order(chosen)


def build_corpus(spark: SparkSession, args: argparse.Namespace, out: str) -> None:
    pubs = selected(spark, args)
    rows = corpus.merge(corpus.preprocess(pubs, args.languages, args.limit or None, args.min_words), args.min_words)
    files.write_csv(corpus.in_output_order(rows, args.languages), out)
    if args.stats:
        files.write_csv(corpus.language_stats(pubs, args.languages, args.min_words).orderBy("language"), args.stats)


def provider_of(name: str | None) -> Callable[[], generation.ModelProvider]:
    if not name:
        return generation.OfflineProvider
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)


def ask(spark: SparkSession, args: argparse.Namespace, source: str, out: str, status: str | None) -> None:
    sample = sampling.stratified_sample(files.dense_index(files.read_corpus(spark, source), "index"), args.sample, SEED)
    results = generation.generate(sample, provider_of(args.provider), args.targets, args.attempts)
    # A provider may answer differently when asked again, so its answers are kept before anything is made of them.
    results.write.mode("overwrite").parquet(f"{out}-results")
    results = spark.read.schema(results.schema).parquet(f"{out}-results")
    files.write_csv(generation.pairs(results), out)
    if status:
        files.write_csv(generation.statuses(results), status)


def package(spark: SparkSession, source: str, qac: str, out: str) -> None:
    docs, rows = files.read_corpus(spark, source), files.dense_index(files.read_qac(spark, qac))
    rows = packaging.identified(rows, docs)
    packaging.write_package(
        out, corpus=packaging.mteb_corpus(docs), queries=packaging.mteb_queries(rows), qrels=packaging.mteb_qrels(rows), qac=packaging.mteb_qac(rows)
    )


def flatten(spark: SparkSession, source: str, qac: str, out: str) -> None:
    docs = files.dense_index(files.read_corpus(spark, source), "ord")
    files.write_csv(packaging.flat_export(files.dense_index(files.read_qac(spark, qac)), docs), out)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.step == "corpus":
        build_corpus(spark, args, args.out)
    elif args.step == "qa":
        ask(spark, args, args.corpus, args.out, args.status)
    elif args.step == "package":
        package(spark, args.corpus, args.qac, args.out)
    elif args.step == "flat":
        flatten(spark, args.corpus, args.qac, args.out)
    else:
        at = f"{args.out.rstrip('/')}/"
        build_corpus(spark, args, f"{at}corpus")
        ask(spark, args, f"{at}corpus", f"{at}qac", args.status or f"{at}status")
        package(spark, f"{at}corpus", f"{at}qac", f"{at}package")
        flatten(spark, f"{at}corpus", f"{at}qac", f"{at}flat")


if __name__ == "__main__":
    run(SparkSession.builder.appName("corpusforge").getOrCreate(), parser().parse_args())

"""Command line: index a corpus, search dev queries, print recall; or search a grid of parameters.

    python -m lexgrid.cli search --corpus corpus.json --queries dev.csv --method BM25_V1 [--save-index DIR]
    python -m lexgrid.cli grid --corpus corpus.json --queries dev.csv --method BM25_V1
    python -m lexgrid.cli submit --corpus corpus.json --queries test.csv --out DIR
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.functions.analysis import analyze
from lexgrid.functions.weighting import METHODS
from lexgrid.operators import index as ix
from lexgrid.operators import search as se
from lexgrid.operators.workspace import shared_folder
from lexgrid.plans import evaluate
from lexgrid.sources import readers
from lexgrid.sources import stopwords as sw


class Help(argparse.HelpFormatter):
    """Shows the defaults that say something."""

    def _get_help_string(self, action: argparse.Action) -> str | None:
        telling = action.default not in (None, False, argparse.SUPPRESS) and action.option_strings
        return f"{action.help or ''} (default: %(default)s)".strip() if telling else action.help


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexgrid", formatter_class=Help)
    p.add_argument("command", choices=("search", "grid", "submit"))
    p.add_argument("--corpus", required=True, help="one JSON array of objects with docid, text, lang")
    p.add_argument("--queries", required=True, help="CSV with query and lang, and positive_docs but for submit; ids are row positions")
    p.add_argument("--method", choices=tuple(METHODS), default="TFIDF", help="weights of the index")
    p.add_argument("--k1", type=float, default=1.5, help="saturation")
    p.add_argument("--b", type=float, default=0.75, help="length normalisation")
    p.add_argument("--d", type=float, default=1.0, help="lower bound's shift")
    p.add_argument("--top", type=int, default=10, help="documents for each query")
    p.add_argument("--stemmer", choices=("identity", "snowball"), default="snowball", help="how words are stemmed")
    p.add_argument("--stems", help="CSV of lang, word, base, for languages without a stemmer here")
    p.add_argument("--stopwords", choices=("default", "v2", "none"), default="default", help="built-in lists to leave out")
    p.add_argument("--stopword-table", help="CSV of lang, word; takes the place of the built-in lists of its languages")
    p.add_argument("--save-index", "--save", dest="save", help="folder for the index")
    p.add_argument("--out", help="folder for results")
    return p


def lists_of(spark: SparkSession, version: str, table: str | None) -> DataFrame | None:
    """(lang, words): the built-in lists of a version, and the user's."""
    lists: dict[str, list[str]] = {}
    if version != "none":
        for g in readers.LANGUAGES:
            try:
                lists[g] = sw.stopwords(g, None if version == "default" else version)
            except ValueError:  # no built-in list: its words stay, unless the user gives one
                continue
    if table:
        rows = sw.read_words(spark, table, "lang string, word string").groupBy("lang").agg(F.collect_set("word").alias("words")).collect()  # a row a language
        lists |= {r["lang"]: r["words"] for r in rows}
    return sw.stopword_table(spark, lists) if lists else None


@contextmanager
def timed(times: dict[str, float], name: str) -> Iterator[None]:
    """Adds the seconds spent within to times."""
    began = time.perf_counter()
    yield
    times[name] = times.get(name, 0.0) + time.perf_counter() - began


def main(argv: list[str] | None = None) -> DataFrame:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexgrid").getOrCreate()
    times: dict[str, float] = {}
    how = {"stemmer": a.stemmer, "stopwords": lists_of(spark, a.stopwords, a.stopword_table)}
    if a.stems:
        how["stems"] = sw.read_words(spark, a.stems, "lang string, word string, base string")
    corpus = readers.in_languages(readers.read_corpus_json(spark, a.corpus), *readers.LANGUAGES).select(F.col("docid").alias("doc_id"), "text", "lang")
    docs = analyze(corpus, **how)
    queries = readers.read_numbered_csv(spark, a.queries, readers.TEST if a.command == "submit" else readers.DEV)
    asked = analyze(queries.select("query_id", F.col("query").alias("text"), "lang"), **how)
    run = {"command": a.command, "corpus": a.corpus, "queries": a.queries, "method": a.method, "k1": a.k1, "b": a.b, "d": a.d, "top": a.top, "stemmer": a.stemmer, "stopwords": a.stopwords}
    if a.command == "grid":
        truth = queries.select("query_id", "lang", F.col("positive_docs").alias("doc_id"))
        metrics = evaluate.grid_search(docs, asked, truth, a.method, evaluate.grid_values(), a.top)
        run = {k: v for k, v in run.items() if k not in ("k1", "b", "d")}
    else:
        path = a.save or shared_folder(spark)
        with timed(times, "build_seconds"):
            index = ix.build_index(docs, a.method, k1=a.k1, b=a.b, d=a.d) if a.command == "search" else ix.build_index(docs, params=evaluate.best_params(spark))
            index = ix.settle(index)  # weights and their order belong to the build; saving moves them
        with timed(times, "save_seconds"):
            ix.save_index(index, path)
        best = {g: m for g, m, *_ in evaluate.BEST}
        index = ix.load_index(spark, path, a.method if a.command == "search" else best)
        if a.command == "submit":
            results = se.search(index, asked, a.top)
            with timed(times, "search_seconds"):
                evaluate.write_submission(results, a.out or "submission")
            print(*(f"{k} {v:.2f}" for k, v in times.items()))
            return evaluate.submission(results)
        truth = queries.select("query_id", "lang", F.col("positive_docs").alias("doc_id"))
        metrics = evaluate.recall_overall(se.search(index, asked, a.top), truth)
    with timed(times, "search_seconds"):
        rows = metrics.collect()  # a row a language, or a language and point of the grid
    metrics = spark.createDataFrame(rows, metrics.schema)
    print(*(f"{k} {v:.2f}" for k, v in times.items()))
    if a.out:
        evaluate.log_metrics(metrics, a.out, run, times)
    metrics.show(10_000, truncate=False)
    return metrics


if __name__ == "__main__":
    main()

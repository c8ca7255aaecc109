"""Stopword lists."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from pathlib import Path

import pyspark
from pyspark import SparkContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession

from lexgrid.sources.stopwords_v2 import V2

NAMES = {"de": "german", "en": "english", "es": "spanish", "fr": "french", "it": "italian"}
#: The short English list of version "v2".
ENGLISH = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
VERSIONS = (None, "v2")


def built_in(name: str) -> list[str]:
    """Spark's list; without a running Spark it is read from the library's own file."""
    if SparkContext._active_spark_context:
        return StopWordsRemover.loadDefaultStopWords(name)
    (jar,) = (Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar")
    with zipfile.ZipFile(jar) as z:
        return z.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode().split("\n")


def stopwords(language: str, version: str | None = None, own: Iterable[str] | None = None) -> list[str]:
    """Words to leave out. own overrides; languages without a built-in list need one (Arabic has none here, Korean in version v2 only)."""
    if version not in VERSIONS:
        raise ValueError(f"stopword version {version!r} is not one of {VERSIONS}")
    if own is not None:
        return sorted(set(own))
    if version == "v2" and language == "en":
        return list(ENGLISH)
    if version == "v2" and language in V2:
        return list(V2[language])
    if language not in NAMES:
        raise ValueError(f"no built-in stopwords for {language!r}: pass your own")
    return sorted(set(filter(None, built_in(NAMES[language]))))


def read_words(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A user's table as CSV with a header: (lang, word) of stopwords, or (lang, word, base) of stems."""
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.read.csv(path, header=True).select(*names)


def stopword_table(spark: SparkSession, lists: dict[str, Iterable[str]]) -> DataFrame:
    """(lang, words): one row a language."""
    return spark.createDataFrame([(k, sorted(set(v))) for k, v in lists.items()], "lang string, words array<string>")

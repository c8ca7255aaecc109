"""Sources with explicit schemas: corpora as one JSON array or Parquet, queries as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.sources import records

CORPUS = "docid string, text string, lang string"
DEV = "query string, positive_docs string, lang string"
TEST = "query string, lang string"
#: Languages that a corpus may hold (F-8).
LANGUAGES = ("ar", "de", "es", "it", "ko", "en", "fr")


def read_corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of objects with docid, text and lang, read in ranges of bytes; other keys are not read."""
    return records.read_json_array(spark, path, CORPUS)


def read_queries_csv(spark: SparkSession, path: str, schema: str = DEV) -> DataFrame:
    """A CSV file with a header, quotes doubled within quotes, and line breaks allowed in them. Columns are found by name."""
    names = [x.split()[0] for x in schema.split(", ")]
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    kinds = dict(x.split() for x in schema.split(", "))
    return raw.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])


def read_numbered_csv(spark: SparkSession, path: str, schema: str = DEV) -> DataFrame:
    """As read_queries_csv, with `query_id`, the positions of the rows from 0 (F-9); a large file is read and numbered in many ranges."""
    return records.read_csv_records(spark, path, schema)


def numbered(df: DataFrame, into: str = "query_id") -> DataFrame:
    """Rows as read with their positions from 0, file by file (F-9). One task numbers them: for queries, not for corpora."""
    placed = df.withColumns({"__file": F.input_file_name(), "__row": F.monotonically_increasing_id()})
    place = F.row_number().over(W.orderBy("__file", "__row")) - 1
    return placed.withColumn(into, place.cast("bigint")).drop("__file", "__row")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_languages(df: DataFrame, *languages: str) -> DataFrame:
    """Rows of the given languages (F-1, F-2, F-8)."""
    return df.where(F.col("lang").isin(*languages))

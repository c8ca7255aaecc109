"""Corpus statistics over analysed documents (lang, doc_id, tokens): A1-A6, V1, V6."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.operators.workspace import materialise


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(lang, n_docs, avg_len), empty documents included."""
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens").cast("double")).alias("avg_len"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, dl, term): a row for each word. The outer form keeps a costly expression for tokens from being repeated."""
    return docs.select("lang", "doc_id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).where("term IS NOT NULL")


def term_frequency(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(lang, doc_id, term, c, dl); terms, a small table (term), restricts it before anything is shuffled."""
    rows = occurrences(docs)
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.groupBy("lang", "doc_id", "term", "dl").agg(F.count("*").alias("c"))


def packed(docs: DataFrame, words: Sequence[str] | None = None) -> DataFrame:
    """(lang, doc_id, dl, terms, counts): a row of docs is counted by itself, in the order of its words, so nothing is shuffled or kept.

    words: those that are counted, if not all are; dl is that of all.
    """
    kept = F.col("tokens") if words is None else F.filter("tokens", lambda t: t.isin(list(words)))  # a hashed set, looked into once a token
    ordered = docs.select("lang", "doc_id", F.size("tokens").alias("dl"), F.sort_array(kept).alias("s"))
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | ~F.get("s", i).eqNullSafe(F.get("s", i - 1)))
    placed = ordered.withColumn("at", F.when(F.size("s") > 0, first).otherwise(F.array().cast("array<int>")))
    counts = F.transform("at", lambda x, i: F.coalesce(F.get("at", i + 1), F.size("s")) - x)
    return placed.select("lang", "doc_id", "dl", F.transform("at", lambda x: F.get("s", x)).alias("terms"), counts.alias("counts"))


def unpacked(rows: DataFrame, terms: DataFrame | None = None, id: str = "doc_id") -> DataFrame:
    """As term_frequency(), of rows of packed(), each a document of its own."""
    out = rows.select("lang", id, "dl", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("lang", id, "p.terms", "dl", "p.counts")
    out = out.toDF("lang", id, "term", "dl", "c").where("term IS NOT NULL").withColumn("c", F.col("c").cast("bigint"))
    return out if terms is None else out.join(terms, "term", "left_semi").select("lang", id, "term", "dl", "c")


def merged(tf: DataFrame) -> DataFrame:
    """Counts of documents that came in several rows, added up."""
    return tf.groupBy(*[c for c in tf.columns if c != "c"]).agg(F.sum("c").alias("c"))


#: Documents in several rows are told to all tasks up to so many.
FEW = 100_000


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, term, c): words are counted where a document lies; only those of documents in several rows are shuffled."""
    rows, keys = packed(docs), ["lang", "doc_id", "term", "c"]
    several = materialise(docs.groupBy("lang", "doc_id").count().where("count > 1").select(F.col("lang").alias("g"), F.col("doc_id").alias("i"), F.lit(True).alias("again")))
    if several.isEmpty():
        return unpacked(rows).select(*keys)
    told = F.broadcast(several) if several.limit(FEW + 1).count() <= FEW else several
    rows = materialise(rows.join(told, rows["lang"].eqNullSafe(told["g"]) & rows["doc_id"].eqNullSafe(told["i"]), "left").drop("g", "i"))
    return unpacked(rows.where("again IS NULL")).select(*keys).unionByName(merged(unpacked(rows.where("again")).select(*keys)))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(lang, term, n): a row of tf is a document that holds the term, so no second distinct is needed."""
    return tf.groupBy("lang", "term").agg(F.count("*").alias("n"))


def vocabulary_size(tf: DataFrame) -> DataFrame:
    """(lang, n_terms, nnz)."""
    return document_frequency(tf).groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n").alias("nnz"))


def vocabulary(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """(lang, term, term_id): ids from 0 by first appearance in the order of a column, which may be of any type, and place.

    First appearances are sorted by ranges and written with their place in the range; running counts of the ranges give each its
    first id, so no task sorts a language's whole vocabulary.
    """
    placed = docs.select("lang", F.col(order).alias("doc"), F.posexplode_outer(F.array_distinct("tokens")).alias("pos", "term")).where("term IS NOT NULL")
    first = placed.groupBy("lang", "term").agg(F.min(F.struct("doc", "pos")).alias("at"))
    ranged = first.repartitionByRange("lang", "at").sortWithinPartitions("lang", "at")
    ranged = materialise(ranged.select("lang", "term", F.monotonically_increasing_id().alias("i")).withColumn("part", F.shiftright("i", 33)))
    parts = ranged.groupBy("lang", "part").agg(F.count("*").alias("new"), F.min("i").alias("low"))
    start = parts.withColumn("start", F.sum("new").over(W.partitionBy("lang").orderBy("part")) - F.col("new")).drop("new")  # a row a range
    return ranged.join(F.broadcast(start), ["lang", "part"]).select("lang", "term", (F.col("start") + F.col("i") - F.col("low")).alias("term_id"))

"""Batch search: query terms meet postings, scores are summed and ranked (J1, J5, J10, A7, A11, K-1 to K-7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.operators.index import Index
from lexgrid.operators.numbering import numbered_by
from lexgrid.operators.workspace import materialise

#: Rows of a query's term in a document that one task sums, on average.
ROWS = 2_000_000
#: Terms of a batch of queries up to which they are sent to all tasks, so that no task gets a frequent term of all documents.
SENT = 200_000
#: Documents that Spark's limited window keeps at most.
FEW = 1000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, [lang,] term, qtf) of analysed queries; a repeated word counts as often as it stands."""
    keys = ["query_id", "lang"] if "lang" in queries.columns else ["query_id"]
    return queries.select(*keys, F.explode_outer("tokens").alias("term")).where("term IS NOT NULL").groupBy(*keys, "term").agg(F.count("*").alias("qtf"))


def in_vocabulary(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, lang, term, qtf) of the terms a language's corpus holds."""
    on = ["lang", "term"] if "lang" in terms.columns else ["term"]
    return terms.join(vocabulary.select("lang", "term"), on).select("query_id", "lang", "term", "qtf")


def near_queries(postings: DataFrame, vocabulary: DataFrame, terms: DataFrame, dealer: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """The postings of the queries' terms, all of a document in one task.

    A posting becomes a row for each query that holds its term only there, so neither those rows nor their sums are shuffled, and
    no task holds a frequent term of all documents. There are as many tasks as keep those rows at about ROWS each. dealer: gives
    the same postings, dealt to so many tasks before they are a row each.
    """
    on = shared(terms)
    asking = terms.groupBy(*on).agg(F.count("*").alias("asking"))
    met = vocabulary.join(asking, on).agg(F.sum(F.col("n") * F.col("asking"))).first()[0] or 0
    tasks = -(-int(met) // ROWS) or 1
    return dealer(tasks) if dealer else postings.join(asking.select(*on), on, "left_semi").repartition(tasks, "lang", "doc_id")


def shared(terms: DataFrame) -> list[str]:
    """What tells a query's term from others: with its language, if it is asked of one only."""
    return ["lang", "term"] if "lang" in terms.columns else ["term"]


def scores(near: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, lang, doc_id, score) of the documents that hold a term of the query; near: as of near_queries()."""
    return near.join(terms, shared(terms)).groupBy("query_id", "lang", "doc_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))


def rank(found: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """The k best of each (query_id, lang): by score, then doc_id. Spark keeps k a task before the shuffle."""
    order = W.partitionBy("query_id", "lang").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("query_id", "lang", "rank", "doc_id", "score")


def pad(top: DataFrame, short: DataFrame, found: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """top, plus documents of score 0 for the queries of `short` (query_id, lang): enough of them to fill k places.

    found: all documents found for those queries. With m of them, the first k + m documents of the language hold k that weren't,
    if there are so many. The largest m is taken first: up to FEW, each task keeps that many documents of a language before any
    are sorted together; beyond that, documents are numbered by sorted ranges.
    """
    found = materialise(found.select("query_id", "lang", "doc_id"))
    counted = found.groupBy("query_id", "lang").agg(F.count("*").alias("m"))
    short = short.join(counted, ["query_id", "lang"], "left").fillna(0, ["m"])
    need = (counted.agg(F.max("m")).first()[0] or 0) + k
    if need <= FEW:
        first = documents.withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy("doc_id")))
    else:
        first = numbered_by(documents, ["lang"], ["doc_id"], "i").withColumn("i", F.col("i") + 1)
    first = first.where(F.col("i") <= need)
    pool = short.join(first.select("lang", "doc_id", "i"), "lang").where(F.col("i") <= F.col("m") + k).select("query_id", "lang", "doc_id")
    zeros = pool.join(found, ["query_id", "lang", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top.select("query_id", "lang", "doc_id", "score").unionByName(zeros)


def search(index: Index, queries: DataFrame, k: int = 10, *, padded: bool = False, digits: int | None = None) -> DataFrame:
    """(query_id, lang, rank, doc_id, score): the k best documents of every query.

    queries: query_id, tokens and, to search one language only, lang; without it every language is searched by itself.
    padded: as if every document had a score, 0 for those without a term. digits: round scores before they are ranked.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")
    terms = query_terms(queries)
    terms = F.broadcast(terms) if terms.count() <= SENT else terms
    near = near_queries(index.postings, index.vocabulary, terms, index.dealer())

    def scored(rows: DataFrame, asked: DataFrame) -> DataFrame:
        found = scores(rows, asked)
        return found if digits is None else found.withColumn("score", F.round("score", digits))

    if not padded:
        return rank(scored(near, terms), k)
    asked = queries if "lang" in queries.columns else queries.select("query_id").crossJoin(F.broadcast(index.documents.select("lang").distinct()))  # one row a language
    top = materialise(rank(scored(near, terms), k))
    full = top.where("score > 0").groupBy("query_id", "lang").agg(F.count("*").alias("above")).where(F.col("above") >= k)
    short = materialise(asked.select("query_id", "lang").distinct().join(full, ["query_id", "lang"], "left_anti"))
    if short.isEmpty():
        return top
    own = terms.join(short, [c for c in ("query_id", "lang") if c in terms.columns])
    return rank(pad(top, short, scored(near_queries(index.postings, index.vocabulary, own, index.dealer()), own), index.documents, k), k)

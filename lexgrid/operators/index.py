"""Inverted indexes: build, save, load."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.functions import weighting
from lexgrid.operators import snapshots, stats
from lexgrid.operators.workspace import materialise, shared_folder


@dataclass
class Index:
    """postings (lang, term, doc_id, weight); documents (lang, doc_id) with empty ones; vocabulary (lang, term, n); meta, a row a language.

    settled: where the postings are already written in the layout of a saved index, if they are. clustered: the postings that
    come in ranges of (lang, term), each sorted by these and doc_id; others that take their place need not. dealt: the postings
    that come from packed counts, and what gives them dealt by document to a number of tasks.
    """

    postings: DataFrame
    documents: DataFrame
    vocabulary: DataFrame
    meta: DataFrame
    settled: str | None = None
    clustered: DataFrame | None = None
    dealt: tuple[DataFrame, Callable[[int], DataFrame]] | None = None

    def dealer(self) -> Callable[[int], DataFrame] | None:
        """What deals the postings by document, unless others took the place of those it gives."""
        return self.dealt[1] if self.dealt and self.dealt[0] is self.postings else None


#: Words of known queries to which texts are restricted where they are counted; if there are more, rows of words are.
WORDS = 20_000


@dataclass
class Packs:
    """Rows of stats.packed(), written. terms: what they are still to be restricted to; several: a document is in several rows."""

    rows: DataFrame
    terms: DataFrame | None
    several: bool

    def frequencies(self, tasks: int | None = None) -> DataFrame:
        """As stats.term_frequency(). tasks: all of a document in one of so many.

        Documents are dealt as they are packed: the task that sends rows holds all it sends until they are sorted, and a row a word
        is many times larger.
        """
        rows = self.rows if tasks is None else self.rows.repartition(tasks, "lang", "doc_id")
        tf = stats.unpacked(rows, self.terms)
        return stats.merged(tf) if self.several else tf

    def counted(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        of = self.rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.avg(F.col("dl").cast("double")).alias("avg_len"))
        tf = self.frequencies()
        return tf, materialise(stats.document_frequency(tf)), materialise(of)


def pack(docs: DataFrame, terms: DataFrame | None = None) -> Packs:
    """Analysed documents, counted where they lie; texts are analysed once."""
    words = None if terms is None else [r["term"] for r in terms.where("term IS NOT NULL").limit(WORDS + 1).collect()]
    few = words is not None and len(words) <= WORDS
    rows = materialise(stats.packed(docs, words if few else None))
    several = not rows.groupBy("lang", "doc_id").count().where("count > 1").isEmpty()
    return Packs(rows, None if few else terms, several)


def counted(docs: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term frequencies, document frequencies, corpus statistics); texts are analysed once, and counted where they lie.

    All but the term frequencies of all words are written: by the size of what is written Spark tells whether document
    frequencies can be sent to all tasks, so that no task gets a frequent term of all documents.
    """
    tf, df, of = pack(docs, terms).counted()
    return tf if terms is None else materialise(tf), df, of


def joined(tf: DataFrame, df: DataFrame, of: DataFrame) -> DataFrame:
    return tf.join(df, ["lang", "term"]).join(F.broadcast(of), "lang")  # a row a language


def gathered(tf: DataFrame, of: DataFrame) -> DataFrame:
    """As joined(), in ranges of (lang, term), each sorted by these and doc_id: documents are counted there, so postings are
    shuffled once, for their weights and for the layout in which they are saved."""
    term = W.partitionBy("lang", "term").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return tf.repartitionByRange("lang", "term").withColumn("n", F.count("*").over(term)).join(F.broadcast(of), "lang")  # a row a language


def statistics(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(lang, doc_id, term, c, dl, n, n_docs, avg_len): all that a weight needs. docs: lang, doc_id, tokens."""
    return joined(*counted(docs, terms))


def weigh(rows: DataFrame, method: str, k1: float, b: float, d: float) -> DataFrame:
    weighting.check(method, k1, b, d)
    w = weighting.weight(method, c=F.col("c"), length=F.col("dl"), mean=F.col("avg_len"), total=F.col("n_docs"), n=F.col("n"), k1=F.lit(float(k1)), b=F.lit(float(b)), d=F.lit(float(d)))
    return rows.withColumn("weight", w).where("weight IS NOT NULL")


def weigh_by_language(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Weights by the row (lang, method, k1, b, d) of the document's language."""
    rows = rows.join(F.broadcast(params), "lang")  # one row a language
    w = weighting.weight_by(F.col("method"), c=F.col("c"), length=F.col("dl"), mean=F.col("avg_len"), total=F.col("n_docs"), n=F.col("n"), k1=F.col("k1"), b=F.col("b"), d=F.col("d"))
    return rows.withColumn("weight", w).where("weight IS NOT NULL")


def build_index(docs: DataFrame, method: str = "BM25_V1", *, k1: float = 1.5, b: float = 0.75, d: float = 1.0, params: DataFrame | None = None, terms: DataFrame | None = None, counts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> Index:
    """Index analysed documents. params gives method and parameters by language instead; terms restricts it to those of known queries.

    counts: what counted() gave for the same documents and terms, if several methods are to share it.
    """
    packs = None if counts or terms is None else pack(docs, terms)
    tf, df, of = packs.counted() if packs else counts or counted(docs, terms)
    by_language = params

    def weighed(rows: DataFrame) -> DataFrame:
        rows = weigh(rows, method, k1, b, d) if by_language is None else weigh_by_language(rows, by_language)
        return rows.select("lang", "term", "doc_id", "weight")

    if params is None:
        params = of.select("lang", F.lit(method).alias("method"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"), F.lit(float(d)).alias("d"))
    unique = df.groupBy("lang").agg(F.count("*").alias("num_unique"))
    meta = params.join(of.select("lang", F.col("n_docs").alias("num_corpus"), "avg_len"), "lang").join(unique, "lang", "left")
    postings = weighed(gathered(tf, of) if terms is None else joined(tf, df, of))
    dealt = (postings, lambda tasks: weighed(joined(packs.frequencies(tasks), df if packs.terms is not None else F.broadcast(df), of))) if packs else None
    return Index(postings, docs.select("lang", "doc_id"), df, meta, clustered=postings if terms is None else None, dealt=dealt)


TABLES = ("postings", "documents", "vocabulary", "meta")


def write_postings(index: Index, path: str) -> None:
    """Postings by method and language, clustered by term."""
    methods = [r["method"] for r in index.meta.select("method").distinct().collect()]  # of eight
    if index.clustered is index.postings and len(methods) == 1:
        index.postings.withColumn("method", F.lit(methods[0])).write.partitionBy("method", "lang").parquet(path)
        return
    postings = index.postings.join(F.broadcast(index.meta.select("lang", "method")), "lang")  # a row a language
    clustered = postings.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "doc_id")
    clustered.write.partitionBy("method", "lang").parquet(path)


def settle(index: Index) -> Index:
    """The index with its postings computed and written in the shared folder, so that saving it moves them, and a search reads them."""
    spark, path = index.meta.sparkSession, shared_folder(index.meta.sparkSession)
    write_postings(index, path)
    return replace(index, postings=spark.read.parquet(path).select("lang", "term", "doc_id", "weight"), settled=path, clustered=None)


def save_index(index: Index, path: str) -> None:
    """Parquet by method and language, postings clustered by term so that a search prunes row groups.

    What is saved is a snapshot of its own, postings with the documents and vocabulary that they were built from. It takes the
    place of the same methods of the same languages when all is written; all else at the path stays, and so does everything if
    the save fails. clean_index() removes what no longer counts.
    """
    spark = index.meta.sparkSession
    pairs = [part_of(r["lang"], r["method"]) for r in index.meta.select("lang", "method").distinct().collect()]  # a row a language

    def write(snapshot: str) -> None:
        to = snapshots.folder_of(path, "postings", snapshot)
        if not index.settled or not snapshots.moved(spark, index.settled, to):
            write_postings(index, to)
        elif index.settled:
            index.postings, index.settled, index.clustered = spark.read.parquet(to).select("lang", "term", "doc_id", "weight"), None, None
        for df, name, keys in ((index.documents, "documents", ["lang"]), (index.vocabulary, "vocabulary", ["lang"]), (index.meta.coalesce(1), "meta", ["method", "lang"])):
            df.write.partitionBy(*keys).parquet(snapshots.folder_of(path, name, snapshot))

    snapshots.publish(spark, path, pairs, write)


def part_of(lang: str, method: str) -> str:
    return f"{method}/{lang}"


def clean_index(spark: SparkSession, path: str) -> int:
    """Remove snapshots that nothing at the path refers to; not while another save is under way."""
    return snapshots.remove_unpublished(spark, path, TABLES)


def chosen(spark: SparkSession, path: str, method: str | dict[str, str] | None, languages: Sequence[str] | None) -> dict[str, list[tuple[str, str]]]:
    """The snapshots to be read, each with its (lang, method): of one method a language."""
    held = {tuple(reversed(part.split("/", 1))): snapshot for part, snapshot in snapshots.manifest(spark, path)[1].items()}  # (lang, method)
    wanted = [(g, m) for g, m in held if (languages is None or g in languages) and (method is None or m == (method.get(g) if isinstance(method, dict) else method))]
    if len({g for g, _ in wanted}) < len(wanted):
        raise ValueError(f"several methods are saved for a language, name one: {sorted(wanted)}")
    if not wanted:
        raise ValueError(f"no such index at {path}; saved are {sorted(held)}")
    by: dict[str, list[tuple[str, str]]] = {}
    for pair in wanted:
        by.setdefault(held[pair], []).append(pair)
    return by


def load_index(spark: SparkSession, path: str, method: str | dict[str, str] | None = None, languages: Sequence[str] | None = None) -> Index:
    """An index of one method a language: of `method`, or the one given by language, or the only one saved; of some languages or all."""
    by = chosen(spark, path, method, languages)

    def read(name: str, methods: bool) -> DataFrame:
        found = []
        for snapshot, pairs in by.items():
            one = [(F.col("lang") == g) & (F.col("method") == m) if methods else F.col("lang") == g for g, m in pairs]
            found.append(spark.read.parquet(snapshots.folder_of(path, name, snapshot)).where(reduce(or_, one)))  # ids may be numbers or strings
        return reduce(DataFrame.unionByName, found)

    return Index(read("postings", True).drop("method"), read("documents", False), read("vocabulary", False), read("meta", True))

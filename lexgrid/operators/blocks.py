"""Blocked postings, and exact top k from them without scoring every posting (I2, J5, K-1, A7).

A row holds the postings of one term in one range of documents: the documents' places in the range, how often each holds the
term, and their lengths, as three arrays of small numbers. Documents are numbered by language in the order of their lengths, then
ids, so that two of the arrays are sorted, and the file format packs them by their differences. Weights are functions of what is
stored and are not stored; the largest of the row is, rounded up. The size of a term's ranges, a power of two, is such that a row
has about SIZE postings on average: a frequent term is split over many rows, a rare one has a single row. The documents of a
language also fall into some ZONES, which no row of a term in FREQUENT or more documents crosses.

The search bounds what a document can gain from each term of a query by the largest weight in its zone (0 for one that lacks the
term, and if all weights are negative); as documents of a zone are of like lengths, so are weights. From the postings of the
strongest terms comes a score that the k-th best document reaches; terms that cannot reach it even together, in a zone, bring in
no documents there. Only the others' postings are read, but for rows whose bound rules all their documents out; the few documents
that remain are looked up in the rows of the terms left out. The result is the same as from all postings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.functions import weighting
from lexgrid.operators import index as ix
from lexgrid.operators import snapshots, stats
from lexgrid.operators.numbering import numbered_by
from lexgrid.operators.search import ROWS, query_terms, rank
from lexgrid.operators.workspace import materialise

#: Postings of a row, on average; and for each result wanted, postings of the strongest terms that are read for a first bound.
SIZE, SEEDS = 256, 10
ZONES, FREQUENT = 16, 1024
#: Terms are left out that together stay below this part of what the k-th best has: 1 reads fewest postings, but leaves most documents to look up.
SPARE = 0.6
WEIGHED = ("method", "k1", "b", "d", "num_corpus", "avg_len")


@dataclass
class BlockIndex:
    """blocks (lang, term, block, shift, n, docs, counts, lengths, top): the documents of a block are those numbered from
    block << shift; vocabulary (lang, term, n, shift, top, low); zones (lang, term, zone, top) of frequent terms, zone being a
    document's number >> zone_shift; documents (lang, doc, doc_id); meta, a row a language."""

    blocks: DataFrame
    vocabulary: DataFrame
    zones: DataFrame
    documents: DataFrame
    meta: DataFrame


def shift_of(documents: Column) -> Column:
    """The least power of two that holds so many documents."""
    return F.greatest(F.ceil(F.log2(documents)), F.lit(0)).cast("int")


def build_blocks(docs: DataFrame, method: str = "BM25_V1", *, k1: float = 1.5, b: float = 0.75, d: float = 1.0, params: DataFrame | None = None, terms: DataFrame | None = None, size: int = SIZE) -> BlockIndex:
    """Index analysed documents (lang, doc_id, tokens), whose ids are unique in a language; arguments as of index.build_index.

    Texts are counted where they lie, and a document's counts get its number before they become a row a word. Postings are
    shuffled once, by term: there they are counted, weighed and put into blocks.
    """
    counts = materialise(stats.packed(docs.where("lang IS NOT NULL")))
    lengths = counts.groupBy("lang", "doc_id").agg(F.min("dl").alias("dl"), F.sum("dl").alias("words"), F.count("*").alias("copies"))
    placed = numbered_by(lengths, ["lang"], ["dl", "doc_id"], "doc")
    of = materialise(placed.groupBy("lang").agg(F.sum("copies").alias("n_docs"), (F.sum("words") / F.sum("copies")).alias("avg_len"), F.max("copies").alias("copies")))
    documents = placed.select("lang", "doc", "doc_id")
    tf = stats.unpacked(counts.join(documents, ["lang", "doc_id"]), terms, "doc")
    if (of.agg(F.max("copies")).first()[0] or 0) > 1:
        tf = stats.merged(tf)
    of = of.drop("copies")
    # By term first: Spark sorts by the beginnings of the first column.
    rows = tf.withColumnRenamed("doc", "doc_id").withColumn("n", F.count("*").over(W.partitionBy("term", "lang"))).join(F.broadcast(of), "lang")  # a row a language
    if params is None:
        rows = ix.weigh(rows, method, k1, b, d)
        params = of.select("lang", F.lit(method).alias("method"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"), F.lit(float(d)).alias("d"))
    else:
        rows = ix.weigh_by_language(rows, params)
    own, zone = shift_of(F.lit(float(size)) * F.col("n_docs") / F.col("n")), shift_of(F.col("n_docs") / ZONES)
    rows = rows.withColumn("shift", F.when(F.col("n") < FREQUENT, own).otherwise(F.least(own, zone)))
    rows = rows.withColumn("block", F.call_function("shiftright", F.col("doc_id"), F.col("shift")))
    place = (F.col("doc_id") - F.call_function("shiftleft", F.col("block"), F.col("shift"))).cast("int")
    one = F.struct(place.alias("doc"), F.col("c").cast("int").alias("c"), F.col("dl").cast("int").alias("dl"))
    grouped = rows.groupBy("term", "lang", "shift", "n", "block").agg(F.sort_array(F.collect_list(one)).alias("p"), F.max("weight").alias("top"), F.min("weight").alias("low"))
    blocks = materialise(grouped.select("lang", "term", "block", "shift", "n", F.col("p.doc").alias("docs"), F.col("p.c").alias("counts"), F.col("p.dl").alias("lengths"), "top", "low"))
    meta = params.join(of.select("lang", F.col("n_docs").alias("num_corpus"), "avg_len", zone.alias("zone_shift")), "lang")
    vocabulary = blocks.groupBy("lang", "term").agg(F.max("n").alias("n"), F.max("shift").alias("shift"), F.max("top").alias("top"), F.min("low").alias("low"))
    frequent = in_zones(blocks.where(F.col("n") >= FREQUENT), meta)
    zones = frequent.groupBy("lang", "term", "zone").agg(F.max("top").alias("top"))
    up = (F.col("top") + F.abs("top") * 1e-6).cast("float")  # never below the largest weight
    return BlockIndex(blocks.drop("low").withColumn("top", up), vocabulary, zones, documents, meta)


def in_zones(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """Blocks of frequent terms with their zones."""
    met = blocks.join(F.broadcast(meta.select("lang", "zone_shift")), "lang")  # a row a language
    return met.withColumn("zone", F.call_function("shiftright", F.call_function("shiftleft", "block", "shift"), F.col("zone_shift"))).drop("zone_shift")


def clustered(blocks: DataFrame) -> DataFrame:
    """Ranges of (lang, term, block), each sorted: what is to be written."""
    return blocks.repartitionByRange("lang", "term", "block").sortWithinPartitions("lang", "term", "block")


#: Packs sorted numbers by their differences and terms by their common beginnings.
PACKED = {"parquet.writer.version": "v2", "compression": "zstd"} | {f"parquet.enable.dictionary#{c}.list.element": "false" for c in ("docs", "lengths")}
TABLES = ("blocks", "vocabulary", "zones", "documents", "meta")
#: Of tables that may have no row, and so no file.
SCHEMAS = {
    "blocks": "term string, block long, shift int, n long, docs array<int>, counts array<int>, lengths array<int>, top float, lang string",
    "vocabulary": "term string, n long, shift int, top double, low double, lang string",
    "zones": "term string, zone long, top double, lang string",
}


def write_blocks(blocks: DataFrame, path: str) -> None:
    clustered(blocks).write.options(**PACKED).partitionBy("lang").parquet(path)


def save_blocks(index: BlockIndex, path: str) -> None:
    """A snapshot at a path of its own, published when all is written, as of index.save_index."""
    spark = index.meta.sparkSession
    parts = [ix.part_of(r["lang"], r["method"]) for r in index.meta.select("lang", "method").distinct().collect()]  # a row a language

    def write(snapshot: str) -> None:
        write_blocks(index.blocks, snapshots.folder_of(path, "blocks", snapshot))
        for name in TABLES[1:]:
            getattr(index, name).write.partitionBy("lang").parquet(snapshots.folder_of(path, name, snapshot))

    snapshots.publish(spark, path, parts, write)


def load_blocks(spark: SparkSession, path: str, method: str | dict[str, str] | None = None, languages: Sequence[str] | None = None) -> BlockIndex:
    """As index.load_index; each language's blocks come with the documents and bounds that they were saved with."""
    by = ix.chosen(spark, path, method, languages)

    def read(name: str) -> DataFrame:
        reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
        found = [reader.parquet(snapshots.folder_of(path, name, s)).where(F.col("lang").isin(*[g for g, _ in pairs])) for s, pairs in by.items()]
        return reduce(DataFrame.unionByName, found)

    return BlockIndex(*[read(name) for name in TABLES])


def weight_of(meta: DataFrame) -> Column:
    """The weight of (c, dl, n) under the columns of meta."""
    methods = [r["method"] for r in meta.select("method").distinct().collect()]  # of eight
    of = {"c": F.col("c"), "length": F.col("dl"), "mean": F.col("avg_len"), "total": F.col("num_corpus"), "n": F.col("n"), "k1": F.col("k1"), "b": F.col("b"), "d": F.col("d")}
    return weighting.weight(methods[0], **of) if len(methods) == 1 else weighting.weight_by(F.col("method"), **of)


def unpacked(rows: DataFrame, *keep: str) -> DataFrame:
    """A row a posting (keep..., doc, c, dl), of rows with blocks' columns."""
    each = F.explode(F.arrays_zip("docs", "counts", "lengths")).alias("p")
    out = rows.select(*keep, F.call_function("shiftleft", F.col("block"), F.col("shift")).alias("first"), each)
    return out.select(*keep, (F.col("first") + F.col("p.docs")).alias("doc"), F.col("p.counts").alias("c"), F.col("p.lengths").alias("dl"))


def postings(index: BlockIndex) -> DataFrame:
    """(lang, term, doc_id, weight) of all postings, as of an unblocked index."""
    rows = unpacked(index.blocks, "lang", "term", "n").join(F.broadcast(index.meta.select("lang", *WEIGHED)), "lang")  # a row a language
    return rows.select("lang", "term", "doc", weight_of(index.meta).alias("weight")).join(index.documents, ["lang", "doc"]).select("lang", "term", "doc_id", "weight")


class TopK:
    """The steps of one search; `reads` tells how many postings each took."""

    Q = ("query_id", "lang")

    def __init__(self, index: BlockIndex, queries: DataFrame, k: int, digits: int | None):
        if k < 1:
            raise ValueError("k must be 1 at least")
        self.index, self.k = index, k
        self.weight = weight_of(index.meta)
        self.about = F.broadcast(index.meta.select("lang", "zone_shift", *WEIGHED))  # a row a language
        self.margin = 10.0**-digits if digits is not None else 0.0  # scores that are rounded to the same are ties
        terms = query_terms(queries)
        asked = terms.join(index.vocabulary, [c for c in ("lang", "term") if c in terms.columns])
        up, down = F.col("qtf") * F.greatest("top", F.lit(0.0)), F.col("qtf") * F.least("low", F.lit(0.0))
        strong = W.partitionBy(*self.Q).orderBy(F.desc("up"), "term").rowsBetween(W.unboundedPreceding, -1)  # a query's terms
        bounded = asked.select(*self.Q, "term", "qtf", "n", "shift", up.alias("up"), down.alias("down"))
        self.terms = materialise(bounded.withColumn("seed", F.coalesce(F.sum("n").over(strong), F.lit(0)) < SEEDS * k))
        self.tasks = -(-int(self.terms.agg(F.sum("n")).first()[0] or 0) // ROWS) or 1

    def less(self, score: Column, bound: Column) -> Column:
        """Whether score is below bound for certain, roundings included; false without a bound."""
        return F.coalesce(score < bound - self.margin - 1e-9 * (1 + F.abs(bound)), F.lit(False))

    def gains(self, rows: DataFrame) -> DataFrame:
        """(Q, doc, zone, score): sums over rows with blocks' columns.

        A task may read blocks of a great many postings, so it sums none of them: each goes to one of as many tasks as keep what
        they sum at about ROWS.
        """
        each = unpacked(rows, *self.Q, "qtf", "n").join(self.about, "lang")
        each = each.select(*self.Q, "doc", F.call_function("shiftright", "doc", "zone_shift").alias("zone"), (F.col("qtf") * self.weight).alias("gain"))
        return each.repartition(self.tasks, *self.Q, "doc", "zone").groupBy(*self.Q, "doc", "zone").agg(F.sum("gain").alias("score"))

    def kth(self, scored: DataFrame, least: Column) -> DataFrame:
        """(Q, bound): what the k-th best of scored has at least, if there are so many."""
        best = F.row_number().over(W.partitionBy(*self.Q).orderBy(F.desc("least")))
        top = scored.select(*self.Q, least.alias("least")).withColumn("i", best).where(F.col("i") <= self.k)
        return top.groupBy(*self.Q).agg(F.min("least").alias("bound"), F.count("*").alias("m")).where(F.col("m") == self.k).drop("m")

    def split(self, bounds: DataFrame) -> DataFrame:
        """(Q, zone, term, qtf, n, shift, down, up, all_up, bound, spare): a query's terms in each zone, and whether documents there
        need not be looked for by the term. A term that isn't frequent is spare in all zones or none."""
        q = list(self.Q)
        often = F.col("n") >= FREQUENT
        frequent = self.terms.where(often).join(self.index.zones.withColumnRenamed("top", "ztop"), ["lang", "term"]).withColumn("up", F.col("qtf") * F.greatest("ztop", F.lit(0.0)))
        last = F.call_function("shiftright", F.col("num_corpus") - 1, F.col("zone_shift"))
        others = self.terms.where(~often).join(self.about, "lang").withColumn("zone", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        columns = [*q, "zone", "term", "qtf", "n", "shift", "down", "up"]
        zone = W.partitionBy(*q, "zone")
        each = frequent.select(*columns).unionByName(others.select(*columns))
        each = each.withColumns({"weaker": F.sum("up").over(zone.orderBy("up", "term")), "all_up": F.sum("up").over(zone)}).join(bounds, q, "left")
        each = each.withColumn("spare", self.less(F.col("weaker"), SPARE * F.col("bound")) & (F.col("bound") > 0))
        everywhere = F.min("spare").over(W.partitionBy(*q, "term"))
        return each.withColumn("spare", F.when(often, F.col("spare")).otherwise(everywhere)).drop("weaker")

    def found_in(self, probes: DataFrame) -> DataFrame:
        """(Q, doc, score) for each document and term of probes (Q, doc, term, qtf, shift, n) of which the document holds the term."""
        blocks = self.index.blocks.drop("n", "shift", "top")
        met = probes.withColumn("block", F.call_function("shiftright", "doc", "shift")).join(blocks, ["lang", "term", "block"])
        at = F.array_position("docs", (F.col("doc") - F.call_function("shiftleft", "block", "shift")).cast("int")).cast("int")
        met = met.withColumn("at", at).where("at > 0").withColumns({"c": F.element_at("counts", F.col("at")), "dl": F.element_at("lengths", F.col("at"))})
        return met.join(self.about, "lang").select(*self.Q, "doc", (F.col("qtf") * self.weight).alias("score"))

    def completed(self, scored: DataFrame, more: DataFrame) -> DataFrame:
        return scored.select(*self.Q, "doc", "score").unionByName(more).groupBy(*self.Q, "doc").agg(F.sum("score").alias("score"))

    def run(self) -> DataFrame:
        q, on, blocks = list(self.Q), ["lang", "term"], self.index.blocks.drop("n", "shift")
        self.seeds = self.terms.where("seed").join(blocks.drop("top"), on)
        order = W.partitionBy(*q).orderBy(F.desc("score"), "doc")
        strong = materialise(self.gains(self.seeds).withColumn("i", F.row_number().over(order)).where(F.col("i") <= 2 * self.k).drop("i", "zone"))
        self.first = strong.drop("score").join(self.terms.where("NOT seed").select(*q, "term", "qtf", "shift", "n"), q)
        whole = self.completed(strong, self.found_in(self.first))
        bounds = materialise(self.kth(whole, F.col("score")))
        terms = materialise(self.split(bounds))
        needed, spare = terms.where("NOT spare"), terms.where("spare")

        rare = needed.where(F.col("n") < FREQUENT).select(*q, "term", "qtf", "n", "shift").distinct()
        hopeless = self.less(F.col("qtf") * F.greatest(F.col("top").cast("double"), F.lit(0.0)) + F.col("all_up") - F.col("up"), F.col("bound"))
        zoned = in_zones(self.index.blocks.where(F.col("n") >= FREQUENT), self.index.meta).drop("n", "shift")
        often = needed.where(F.col("n") >= FREQUENT).join(zoned, [*on, "zone"]).where(~hopeless)
        columns = [*q, "qtf", "n", "shift", "block", "docs", "counts", "lengths"]
        self.read = rare.join(blocks, on).select(*columns).unionByName(often.select(*columns))

        left = spare.groupBy(*q, "zone").agg(F.sum("up").alias("left"), F.sum("down").alias("lost"))
        scored = self.gains(self.read).join(left, [*q, "zone"], "left").fillna(0.0, ["left", "lost"])
        reach = F.col("score") + F.col("left")
        scored = materialise(scored.join(bounds, q, "left").where(~self.less(reach, F.col("bound"))).drop("bound"))
        better = self.kth(scored, F.col("score") + F.col("lost"))
        kept = materialise(scored.join(better, q, "left").where(~self.less(reach, F.col("bound"))).select(*q, "zone", "doc", "score"))

        self.probes = kept.join(spare.select(*q, "zone", "term", "qtf", "shift", "n"), [*q, "zone"])
        return self.completed(kept, self.found_in(self.probes))

    def reads(self) -> DataFrame:
        """(query_id, lang, postings, seeds, read, probed): postings of all the query's terms, those read by each step, and single
        documents looked up in a term's row; after run()."""
        q = list(self.Q)
        total = self.terms.groupBy(*q).agg(F.sum("n").alias("postings"))
        taken = lambda rows, name: rows.groupBy(*q).agg(F.sum(F.size("docs")).alias(name))
        probed = self.first.select(*q).unionAll(self.probes.select(*q)).groupBy(*q).agg(F.count("*").alias("probed"))
        return total.join(taken(self.seeds, "seeds"), q, "left").join(taken(self.read, "read"), q, "left").join(probed, q, "left").fillna(0, ["seeds", "read", "probed"])


def search_blocks(index: BlockIndex, queries: DataFrame, k: int = 10, *, digits: int | None = None) -> DataFrame:
    """(query_id, lang, rank, doc_id, score): the k best documents of every query, as of search.search() without padding."""
    found = TopK(index, queries, k, digits).run().join(index.documents, ["lang", "doc"])
    if digits is not None:
        found = found.withColumn("score", F.round("score", digits))
    return rank(found, k)

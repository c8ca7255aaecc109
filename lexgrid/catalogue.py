"""Registered queries of the retrieval engine over documents and benchmark, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.functions import stemming, weighting
from lexgrid.functions.analysis import analyze
from lexgrid.operators import blocks as bl
from lexgrid.operators import index as ix
from lexgrid.operators import search as se
from lexgrid.operators import stats
from lexgrid.operators.workspace import shared_folder
from lexgrid.plans import evaluate
from lexgrid.sources import records
from lexgrid.sources.readers import CORPUS, in_languages, read_table
from lexgrid.sources.stopwords import ENGLISH, stopword_table, stopwords

Query = Callable[[SparkSession, str], DataFrame]
K1, B, D = 1.5, 0.75, 1.0
#: Points of the small grid; grid_search_full takes all of evaluate.grid_values().
GRID = [(k1, b, d) for k1 in (1.2, 1.5) for b in (0.6, 0.75) for d in (1.0, 0.5)]
OOV = "zzzzqqqq"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("lang", "doc_id", "text")


def docs(spark: SparkSession, d: str, **options) -> DataFrame:
    return analyze(raw(spark, d), **options)


def asked(spark: SparkSession, d: str) -> DataFrame:
    return analyze(read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def terms_of(queries: DataFrame) -> DataFrame:
    return se.query_terms(queries).select("term").distinct()


def named(results: DataFrame) -> DataFrame:
    return results.withColumnRenamed("query_id", "item_id")


def truth(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, lang, doc_id): for each benchmark text and language the smallest doc_id whose text contains it.

    Candidates come from an equi-join on the text's second to fourth word, which any text that contains it must have; texts of
    fewer than five words have no such words for certain, and are looked for in all documents.
    """
    items = read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    anchored = analyze(items.withColumn("text", F.col("item"))).select("query_id", "item", F.xxhash64(F.get("tokens", F.lit(1)), F.get("tokens", F.lit(2)), F.get("tokens", F.lit(3))).alias("h"), F.size("tokens").alias("n"))
    t = F.col("tokens")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))
    placed = docs(spark, d).select("lang", "doc_id", F.explode(F.array_distinct(runs)).alias("h"))
    near = placed.join(F.broadcast(anchored.where("n > 4").select("h", "query_id", "item")), "h").select("doc_id", "query_id", "item").distinct()  # a row a benchmark text
    short = raw(spark, d).join(F.broadcast(anchored.where("n <= 4").select("query_id", "item")), F.contains("text", "item")).select("lang", "doc_id", "query_id")
    found = raw(spark, d).join(near, "doc_id").where(F.contains("text", "item")).select("lang", "doc_id", "query_id").unionByName(short)
    return found.groupBy("query_id", "lang").agg(F.min("doc_id").alias("doc_id"))


def search_by(method: str, *, padded: bool = False, k: int = 10, **parameters: float) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        queries = asked(spark, d)
        index = ix.build_index(docs(spark, d), method, terms=terms_of(queries), **parameters)
        return named(se.search(index, queries, k, padded=padded, digits=6))

    return run


def topk_by(method: str, *, k: int = 10, **parameters: float) -> Query:
    """The k best from blocked postings, without scoring them all."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        queries = asked(spark, d)
        index = bl.build_blocks(docs(spark, d), method, terms=terms_of(queries), **parameters)
        return named(bl.search_blocks(index, queries, k, digits=6))

    return run


def index_blocked(spark: SparkSession, d: str) -> DataFrame:
    """All postings, from blocks that were saved and loaded."""
    path = shared_folder(spark)
    bl.save_blocks(bl.build_blocks(docs(spark, d), "BM25_V1"), path)
    return bl.postings(bl.load_blocks(spark, path)).withColumn("weight", F.round("weight", 6))


def topk_best(spark: SparkSession, d: str) -> DataFrame:
    """Each language by its best method."""
    queries = asked(spark, d)
    index = bl.build_blocks(docs(spark, d), params=evaluate.best_params(spark), terms=terms_of(queries))
    return named(bl.search_blocks(index, queries, 10, digits=6))


def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return in_languages(read_table(spark, d, "documents"), "de", "en").select("doc_id", "lang", "source", "n_chars")


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "lang", F.size("tokens").cast("bigint").alias("n_tokens"), F.get("tokens", F.lit(0)).alias("first_token"))


def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    both = raw(spark, d).select("lang", "doc_id", "text")
    kept = analyze(both.withColumn("all", F.size(F.expr("regexp_extract_all(lower(coalesce(text, '')), '[\\\\p{L}\\\\p{N}_]{2,}', 0)"))), stopwords=ENGLISH)
    return kept.select("doc_id", F.size("tokens").cast("bigint").alias("kept"), (F.col("all") - F.size("tokens")).cast("bigint").alias("dropped"))


def stopword_filter_default(spark: SparkSession, d: str) -> DataFrame:
    lists = stopword_table(spark, {g: stopwords(g) for g in ("de", "en", "es", "fr")})
    return stats.document_frequency(stats.term_frequency(docs(spark, d, stopwords=lists)))


def stem_identity(spark: SparkSession, d: str) -> DataFrame:
    return stats.occurrences(docs(spark, d)).select("lang", F.col("term").alias("word")).distinct().withColumn("base", F.col("word"))


def stem_snowball(spark: SparkSession, d: str) -> DataFrame:
    return stemming.stem_words(stats.occurrences(docs(spark, d)).select("lang", F.col("term").alias("word")).distinct())


#: A small table of bases (lang, word, base), as a user may give it: plural endings and articles.
BASES = [(g, w, b) for g, pairs in {"en": "and:and of:of the:a ing:a tion:tion reer:re", "de": "der:d die:d das:d den:d sich:s ung:u", "fr": "le:l la:l les:l de:d des:d", "es": "el:l la:l los:l las:l de:d del:d"}.items() for w, b in (x.split(":") for x in pairs.split())]


def bases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASES, "lang string, word string, base string")


def tf_based_tokens(spark: SparkSession, d: str) -> DataFrame:
    return stats.frequencies(stemming.based_tokens(docs(spark, d), bases(spark)))


def tf_based(spark: SparkSession, d: str) -> DataFrame:
    return stemming.based_frequencies(stats.term_frequency(docs(spark, d)), bases(spark)).select("lang", "doc_id", "term", "c")


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_stats(docs(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return named(se.query_terms(asked(spark, d)))


def query_terms_in_vocab(spark: SparkSession, d: str) -> DataFrame:
    queries = asked(spark, d)
    return named(se.in_vocabulary(se.query_terms(queries), stats.document_frequency(stats.term_frequency(docs(spark, d), terms_of(queries)))))


def idf_of(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        analysed = docs(spark, d)
        rows = stats.document_frequency(stats.term_frequency(analysed)).join(F.broadcast(stats.corpus_stats(analysed)), "lang")  # a row a language
        return rows.select("lang", "term", "n", F.round(weighting.IDF[name](F.col("n_docs").cast("double"), F.col("n").cast("double")), 6).alias("idf"))

    return run


def tf_of(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        analysed = docs(spark, d)
        rows = stats.term_frequency(analysed).join(F.broadcast(stats.corpus_stats(analysed)), "lang")  # a row a language
        tf = weighting.TF[name](F.col("c").cast("double"), F.col("dl").cast("double"), F.col("avg_len"), F.lit(K1), F.lit(B), F.lit(D))
        return rows.select("lang", "doc_id", "term", F.round(tf, 6).alias("tf"))

    return run


def index_by(method: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return ix.build_index(docs(spark, d), method).postings.withColumn("weight", F.round("weight", 6))

    return run


def search_oov(spark: SparkSession, d: str) -> DataFrame:
    queries = analyze(spark.createDataFrame([(0, OOV)], "query_id bigint, text string"))
    index = ix.build_index(docs(spark, d), "BM25_V1", terms=terms_of(queries))
    return named(se.search(index, queries, 10, padded=True, digits=6))


def best_results(spark: SparkSession, d: str, queries: DataFrame) -> DataFrame:
    index = ix.build_index(docs(spark, d), params=evaluate.best_params(spark), terms=terms_of(queries))
    return se.search(index, queries, 10, digits=6)


def search_best(spark: SparkSession, d: str) -> DataFrame:
    return named(best_results(spark, d, asked(spark, d)))


def recall_at_10(spark: SparkSession, d: str) -> DataFrame:
    queries = asked(spark, d)
    results = se.search(ix.build_index(docs(spark, d), "BM25_V1", terms=terms_of(queries)), queries, 10, digits=6)
    return evaluate.recall(results, truth(spark, d)).withColumn("recall", F.round("recall", 6))


def recall_overall(spark: SparkSession, d: str) -> DataFrame:
    results = best_results(spark, d, asked(spark, d))
    return evaluate.recall_overall(results, truth(spark, d)).withColumn("recall", F.round("recall", 6))


def grid_of(points: list[tuple[float, float, float]]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return evaluate.grid_search(docs(spark, d), asked(spark, d), truth(spark, d), "BM25_V1", points, digits=6).withColumn("recall", F.round("recall", 6))

    return run


def submission(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text is asked of one language only."""
    lang = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("query_id") % 4 + 1).cast("int"))
    return evaluate.submission(best_results(spark, d, asked(spark, d).withColumn("lang", lang)))


def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two methods are saved at one path, and one is loaded."""
    path, analysed = shared_folder(spark), docs(spark, d)
    counts = ix.counted(analysed)
    for method in ("BM25_V1", "TFIDF"):
        ix.save_index(ix.build_index(analysed, method, counts=counts), path)
    return named(se.search(ix.load_index(spark, path, "BM25_V1"), asked(spark, d), 10, digits=6))


def index_interrupted(spark: SparkSession, d: str) -> DataFrame:
    """A later save of the same method, of other documents, fails between its tables; what is loaded is the earlier one."""
    path, index = shared_folder(spark), ix.build_index(docs(spark, d), "BM25_V1")
    ix.save_index(index, path)
    half = ix.build_index(docs(spark, d).where("doc_id % 2 = 0"), "BM25_V1")
    half.vocabulary = half.vocabulary.withColumn("n", F.col("n") + F.raise_error(F.lit("lost")).cast("bigint"))
    try:
        ix.save_index(half, path)
    except PySparkException:
        return named(se.search(ix.load_index(spark, path), asked(spark, d), 10, digits=6))
    raise AssertionError("the save should have failed")


def corpus_json(spark: SparkSession, d: str) -> DataFrame:
    """The documents, written as JSON arrays and read in ranges of bytes."""
    path = shared_folder(spark)
    rows = read_table(spark, d, "documents").select((F.col("doc_id") % 64).alias("i"), F.struct(F.col("doc_id").cast("string").alias("docid"), "text", "lang").alias("r"))
    spread = rows.groupBy("i", F.pmod(F.xxhash64("r.docid"), F.lit(1024)).alias("j")).agg(F.to_json(F.collect_list("r")).alias("value"))
    spread.select("value").write.text(path)
    return records.read_json_array(spark, path, CORPUS).select(F.col("docid").cast("bigint").alias("doc_id"), "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def queries_csv(spark: SparkSession, d: str) -> DataFrame:
    """The documents' texts as queries with line breaks, written as CSV and read in ranges of bytes; positions count from 0."""
    path = shared_folder(spark)
    rows = read_table(spark, d, "documents").select(F.translate("text", "\r", " ").alias("query"), "doc_id", "lang").where("query <> ''")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    got = records.read_csv_records(spark, path, "doc_id bigint, query string, lang string", into="place")
    told = got.agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("last"))
    each = got.select("doc_id", "lang", F.md5(F.col("query").cast("binary")).alias("query_md5"))
    return each.join(F.broadcast(told.select(((F.col("n") == F.col("places")) & (F.col("last") == F.col("n") - 1)).alias("numbered"))))  # one row


def query_terms_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts without English stopwords."""
    items = read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return named(se.query_terms(analyze(items, stopwords=ENGLISH)))


def vocab_string_ids(spark: SparkSession, d: str) -> DataFrame:
    """First appearance in the order of string ids."""
    return stats.vocabulary(docs(spark, d).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))


# SQL

BASE = r"""docs AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS tokens FROM documents),
words AS (SELECT lang, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM docs),
tf AS (SELECT lang, doc_id, term, any_value(dl) AS dl, count(*) AS c FROM words GROUP BY lang, doc_id, term),
stats AS (SELECT lang, count(*) AS n_docs, avg(len(tokens)) AS avg_len FROM docs GROUP BY lang),
vocab AS (SELECT lang, term, count(*) AS n FROM tf GROUP BY lang, term),
items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS tokens FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(tokens) AS term FROM items) GROUP BY item_id, term)"""
BENCH_TRUTH = "truth AS (SELECT b.item_id, d.lang, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id, d.lang)"


def sql_tf(name: str, k1: str = f"{K1}::DOUBLE", b: str = f"{B}::DOUBLE", d: str = f"{D}::DOUBLE") -> str:
    sat = f"({k1} * (1 - {b} * (1 - dl / avg_len)))"
    inner = f"({d} + c / (1 - {b} + {b} * dl / avg_len))"
    return {
        "ratio": "(c::DOUBLE / dl)",
        "saturating": f"(c / (c + {sat}))",
        "plus": f"({d} + (1 + {k1}) * c / (c + {sat}))",
        "ldp": f"(CASE WHEN {inner} > 0 THEN CASE WHEN 1 + ln({inner}) > 0 THEN 1 + ln(1 + ln({inner})) END END)",
    }[name]


def sql_idf(name: str) -> str:
    q = "(n::DOUBLE / n_docs)"
    dlite = f"((1 - {q}) / 2 + (1 - {q} * (1 - ln({q}))) - (1 - {q} * {q} * (1 - 2 * ln({q}))) / (2 + 2 * {q}))"
    return {
        "smooth": "(ln((1 + n_docs)::DOUBLE / (1 + n)) + 1)",
        "okapi": "ln((n_docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE) + 1)",
        "logn1": "ln((n_docs + 1)::DOUBLE / n)",
        "dlite": dlite,
        "dlite_cbrt": f"cbrt({dlite})",
    }[name]


def sql_weight(method: str, **parameters: str) -> str:
    tf, idf, _ = weighting.METHODS[method]
    return f"{sql_tf(tf, **parameters)} * {sql_idf(idf)}"


def sql_post(weight: str, extra: str = "") -> str:
    return f"WITH {BASE}{extra}, post AS (SELECT lang, term, doc_id, {weight} AS weight FROM tf JOIN vocab USING (lang, term) JOIN stats USING (lang))"


FOUND = "found AS (SELECT item_id, lang, doc_id, round(sum(qtf * weight), 6) AS score FROM qt JOIN post USING (term) WHERE weight IS NOT NULL GROUP BY item_id, lang, doc_id)"
RANKED = "ranked AS (SELECT item_id, lang, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM {}), top AS (SELECT * FROM ranked WHERE rank <= 10)"
TOP = "SELECT item_id, lang, rank, doc_id, score FROM top"


def sql_search(method: str, **parameters: str) -> str:
    return f"{sql_post(sql_weight(method, **parameters))}, {FOUND}, {RANKED.format('found')} {TOP}"


def sql_padded(method: str, items: str = "(SELECT item_id FROM benchmark)", **parameters: str) -> str:
    everything = f"padded AS (SELECT i.item_id, d.lang, d.doc_id, coalesce(f.score, 0.0::DOUBLE) AS score FROM {items} i CROSS JOIN docs d LEFT JOIN found f ON f.item_id = i.item_id AND f.lang = d.lang AND f.doc_id = d.doc_id)"
    return f"{sql_post(sql_weight(method, **parameters))}, {FOUND}, {everything}, {RANKED.format('padded')} {TOP}"


def sql_best() -> str:
    rows = ", ".join(f"('{g}', '{m}', {k1}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for g, m, k1, b, d in evaluate.BEST)
    cases = " ".join(f"WHEN '{m}' THEN {sql_weight(m, k1='k1', b='b', d='d')}" for m in weighting.METHODS)
    return f"WITH {BASE}, params AS (SELECT * FROM (VALUES {rows}) p(lang, method, k1, b, d)), post AS (SELECT lang, term, doc_id, CASE method {cases} END AS weight FROM tf JOIN vocab USING (lang, term) JOIN stats USING (lang) JOIN params USING (lang))"


SQL_BEST_TOP = f"{sql_best()}, {FOUND}, {RANKED.format('found')}"
SQL_TOP = f"{sql_post(sql_weight('BM25_V1'))}, {FOUND}, {RANKED.format('found')}"
HITS = f"{BENCH_TRUTH}, hits AS (SELECT t.lang, CASE WHEN top.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit FROM truth t LEFT JOIN top ON top.item_id = t.item_id AND top.lang = t.lang AND top.doc_id = t.doc_id)"


def sql_grid(grid: list[tuple[float, float, float]]) -> str:
    points = ", ".join(f"({k1}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for k1, b, d in grid)
    return f"""WITH {BASE}, grid AS (SELECT * FROM (VALUES {points}) g(k1, b, d)),
found AS (SELECT k1, b, d, item_id, lang, doc_id, round(sum(qtf * {sql_weight('BM25_V1', k1='k1', b='b', d='d')}), 6) AS score FROM qt JOIN tf USING (term) JOIN vocab USING (lang, term) JOIN stats USING (lang) CROSS JOIN grid GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, d, item_id, lang ORDER BY score DESC, doc_id) AS rank FROM found) WHERE rank <= 10), {BENCH_TRUTH}
SELECT g.k1, g.b, g.d, t.lang, round(avg(CASE WHEN top.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS recall
FROM truth t CROSS JOIN grid g LEFT JOIN top ON top.k1 = g.k1 AND top.b = g.b AND top.d = g.d AND top.item_id = t.item_id AND top.lang = t.lang AND top.doc_id = t.doc_id GROUP BY ALL"""


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "scan_documents_by_lang": scan_documents,
        "distinct_langs": lambda s, d: read_table(s, d, "documents").select("lang").distinct(),
        "tokenize": tokenize,
        "stopword_filter": stopword_filter,
        "stopword_filter_default": stopword_filter_default,
        "stem_identity": stem_identity,
        "stem_snowball": stem_snowball,
        "tf_based": tf_based,
        "tf_based_tokens": tf_based_tokens,
        "corpus_stats": corpus_stats,
        "term_frequency": lambda s, d: stats.term_frequency(docs(s, d)).select("lang", "doc_id", "term", "c"),
        "document_frequency": lambda s, d: stats.document_frequency(stats.term_frequency(docs(s, d))),
        "vocab_size_nnz": lambda s, d: stats.vocabulary_size(stats.term_frequency(docs(s, d))),
        "vocab_first_appearance": lambda s, d: stats.vocabulary(docs(s, d)),
        "vocab_string_ids": vocab_string_ids,
        "query_terms": query_terms,
        "query_terms_filtered": query_terms_filtered,
        "query_terms_in_vocab": query_terms_in_vocab,
    }
    found |= {f"idf_{n}": idf_of(n) for n in weighting.IDF}
    found |= {f"tf_{n}": tf_of(n) for n in weighting.TF}
    found |= {f"index_{m.lower()}": index_by(m) for m in weighting.METHODS}
    found |= {f"search_{m.lower()}": search_by(m) for m in weighting.METHODS}
    found |= {f"topk_{m.lower()}": topk_by(m) for m in weighting.METHODS}
    return found | {
        "topk_ldp_negative": topk_by("TF_LDP", b=0.8, d=0.4),
        "topk_best_by_lang": topk_best,
        "index_blocked": index_blocked,
        "search_padded": search_by("BM25_V1", padded=True),
        "search_oov_query": search_oov,
        "search_ldp_negative": search_by("TF_LDP", padded=True, b=0.8, d=0.4),
        "search_best_by_lang": search_best,
        "recall_at_10": recall_at_10,
        "recall_overall": recall_overall,
        "grid_search_bm25": grid_of(GRID),
        "grid_search_full": grid_of(evaluate.grid_values()),
        "submission": submission,
        "index_round_trip": index_round_trip,
        "index_interrupted": index_interrupted,
        "corpus_json": corpus_json,
        "queries_csv": queries_csv,
    }


def oracle_sql() -> dict[str, str]:
    listed = ", ".join(f"'{w}'" for w in ENGLISH)
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    defaults = ", ".join(f"('{g}', {quoted(w)})" for g in ("de", "en", "es", "fr") for w in stopwords(g))
    found = {
        "scan_documents_by_lang": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('de', 'en')",
        "distinct_langs": "SELECT DISTINCT lang FROM documents",
        "tokenize": f"WITH {BASE} SELECT doc_id, lang, len(tokens) AS n_tokens, tokens[1] AS first_token FROM docs",
        "stopword_filter": f"WITH {BASE}, k AS (SELECT doc_id, len(tokens) AS total, len(list_filter(tokens, lambda t: t NOT IN ({listed}))) AS kept FROM docs) SELECT doc_id, kept, total - kept AS dropped FROM k",
        "stopword_filter_default": f"WITH {BASE}, gone AS (SELECT * FROM (VALUES {defaults}) g(lang, term)) SELECT lang, term, n FROM vocab ANTI JOIN gone USING (lang, term)",
        "stem_identity": f"WITH {BASE} SELECT DISTINCT lang, term AS word, term AS base FROM words",
        "corpus_stats": f"WITH {BASE} SELECT lang, n_docs, round(avg_len, 6) AS avg_len FROM stats",
        "term_frequency": f"WITH {BASE} SELECT lang, doc_id, term, c FROM tf",
        "document_frequency": f"WITH {BASE} SELECT lang, term, n FROM vocab",
        "vocab_size_nnz": f"WITH {BASE} SELECT lang, count(*) AS n_terms, sum(n)::BIGINT AS nnz FROM vocab GROUP BY lang",
        "vocab_first_appearance": f"WITH {BASE}, placed AS (SELECT lang, doc_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM docs), first AS (SELECT lang, term, min((doc_id, pos)) AS first_at FROM placed GROUP BY lang, term) SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY first_at) - 1 AS term_id FROM first",
        "vocab_string_ids": f"WITH {BASE}, placed AS (SELECT lang, 'd' || doc_id AS doc_id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM docs), first AS (SELECT lang, term, min((doc_id, pos)) AS first_at FROM placed GROUP BY lang, term) SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY first_at) - 1 AS term_id FROM first",
        "query_terms": f"WITH {BASE} SELECT item_id, term, qtf FROM qt",
        "query_terms_filtered": f"WITH {BASE} SELECT item_id, term, qtf FROM qt WHERE term NOT IN ({listed})",
        "query_terms_in_vocab": f"WITH {BASE} SELECT item_id, lang, term, qtf FROM qt JOIN vocab USING (term)",
    }
    values = ", ".join(f"('{g}', '{w}', '{b}')" for g, w, b in BASES)
    based = f"WITH {BASE} SELECT t.lang, t.doc_id, coalesce(b.base, t.term) AS term, count(*) AS c FROM words t LEFT JOIN (VALUES {values}) b(lang, term, base) ON b.lang = t.lang AND b.term = t.term GROUP BY ALL"
    found |= {"tf_based": based, "tf_based_tokens": based}
    found |= {f"idf_{n}": f"WITH {BASE} SELECT lang, term, n, round({sql_idf(n)}, 6) AS idf FROM vocab JOIN stats USING (lang)" for n in weighting.IDF}
    found |= {f"tf_{n}": f"WITH {BASE} SELECT lang, doc_id, term, round({sql_tf(n)}, 6) AS tf FROM tf JOIN stats USING (lang)" for n in weighting.TF}
    found |= {f"index_{m.lower()}": f"{sql_post(sql_weight(m))} SELECT lang, term, doc_id, round(weight, 6) AS weight FROM post WHERE weight IS NOT NULL" for m in weighting.METHODS}
    found |= {f"search_{m.lower()}": sql_search(m) for m in weighting.METHODS}
    found |= {f"topk_{m.lower()}": sql_search(m) for m in weighting.METHODS}
    return found | {
        "topk_ldp_negative": sql_search("TF_LDP", b="0.8::DOUBLE", d="0.4::DOUBLE"),
        "topk_best_by_lang": f"{SQL_BEST_TOP} {TOP}",
        "index_blocked": found["index_bm25_v1"],
        "search_padded": sql_padded("BM25_V1"),
        "search_oov_query": f"WITH {BASE}, r AS (SELECT 0::BIGINT AS item_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, doc_id, 0.0::DOUBLE AS score FROM docs) SELECT * FROM r WHERE rank <= 10",
        "search_ldp_negative": sql_padded("TF_LDP", b="0.8::DOUBLE", d="0.4::DOUBLE"),
        "search_best_by_lang": f"{SQL_BEST_TOP} {TOP}",
        "recall_at_10": f"{SQL_TOP}, {HITS} SELECT lang, count(*) AS n_queries, round(avg(hit), 6) AS recall FROM hits GROUP BY lang",
        "recall_overall": f"{SQL_BEST_TOP}, {HITS} SELECT coalesce(lang, '*') AS lang, count(*) AS n_queries, round(avg(hit), 6) AS recall FROM hits GROUP BY ROLLUP (lang)",
        "grid_search_bm25": sql_grid(GRID),
        "grid_search_full": sql_grid(evaluate.grid_values()),
        "submission": f"{SQL_BEST_TOP} SELECT item_id AS id, '[' || string_agg('''' || doc_id || '''', ', ' ORDER BY rank) || ']' AS docids FROM top WHERE lang = (['de', 'en', 'es', 'fr'])[item_id % 4 + 1] GROUP BY item_id",
        "index_round_trip": sql_search("BM25_V1"),
        "index_interrupted": sql_search("BM25_V1"),
        "corpus_json": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
        "queries_csv": "SELECT doc_id, lang, md5(translate(text, chr(13), ' ')) AS query_md5, true AS numbered FROM documents WHERE text <> ''",
    }

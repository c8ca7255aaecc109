import math

import pytest
from conftest import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry_module
from lexgrid import catalogue
from lexgrid.functions import weighting
from lexgrid.functions.analysis import analyze
from lexgrid.operators import index as ix
from lexgrid.operators import search as se
from lexgrid.operators import stats
from lexgrid.plans import evaluate
from lexgrid.sources import readers

TOY = [("xx", 0, "apple apple banana"), ("xx", 1, "banana cherry"), ("xx", 2, "")]
#: method: w(0, apple), w(0, banana), w(1, banana), w(1, cherry), score 0, score 1 for "apple banana banana"
GOLDEN = {
    "TFIDF": (1.128765, 0.429227, 0.643841, 0.846574, 1.987220, 1.287682),
    "BM25_V1": (0.445831, 0.138236, 0.172478, 0.359937, 0.722304, 0.344957),
    "BM25_V2": (0.769612, 0.378730, 0.472544, 0.621338, 1.527072, 0.945088),
    "BM25_PLUS": (2.961629, 1.202814, 1.329062, 2.658124, 5.367257, 2.658124),
    "BM25_PLUS_V2": (2.095408, 0.815595, 0.901200, 1.880673, 3.726597, 1.802399),
    "DLITE": (0.178188, 0.050337, 0.062806, 0.143858, 0.278863, 0.125613),
    "DLITE_CBRT": (0.332668, 0.163297, 0.203747, 0.268576, 0.659262, 0.407493),
    "TF_LDP": (2.209532, 0.967465, 1.029977, 2.059953, 4.144462, 2.059953),
}


@pytest.fixture(scope="module")
def toy(spark):
    return analyze(spark.createDataFrame(TOY, "lang string, doc_id long, text string")).cache()


def ask(spark, *texts):
    return analyze(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))


@pytest.mark.parametrize("method", GOLDEN)
def test_golden_values(spark, toy, method):
    index = ix.build_index(toy, method)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in index.postings.collect()}
    want = GOLDEN[method]
    for key, w in zip([(0, "apple"), (0, "banana"), (1, "banana"), (1, "cherry")], want):
        assert got[key] == pytest.approx(w, abs=1e-6)
    rows = se.search(index, ask(spark, "apple banana banana"), padded=True).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in rows] == [(1, 0), (2, 1), (3, 2)]
    assert [r["score"] for r in rows] == pytest.approx([want[4], want[5], 0], abs=1e-6)


def test_empty_documents_count(toy):
    row = stats.corpus_stats(toy).first()
    assert (row["n_docs"], row["avg_len"]) == (3, pytest.approx(5 / 3))


def test_unknown_and_empty_queries(spark, toy):
    index = ix.build_index(toy)
    queries = ask(spark, "zzzz", "", "apple")
    plain = se.search(index, queries, 2).collect()
    assert {(r["query_id"], r["doc_id"]) for r in plain} == {(2, 0)}
    padded = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in se.search(index, queries, 2, padded=True).collect()}
    assert len(padded) == 6 and padded[0, 1] == (0, 0.0) and padded[0, 2] == (1, 0.0) and padded[1, 1] == (0, 0.0) and padded[2, 2] == (1, 0.0)


def test_repeated_terms_count_twice(spark, toy):
    rows = {r["query_id"]: r["score"] for r in se.search(ix.build_index(toy), ask(spark, "apple", "apple apple")).collect()}
    assert rows[1] == pytest.approx(2 * rows[0])


def test_more_places_than_documents(spark, toy):
    assert se.search(ix.build_index(toy), ask(spark, "apple"), 10, padded=True).count() == 3


def test_negative_weights_rank_below_unmatched(spark):
    long = "rare " + " ".join(["filler"] * 60)
    docs = analyze(spark.createDataFrame([("xx", 0, long)] + [("xx", i, "other words") for i in range(1, 30)], "lang string, doc_id long, text string"))
    rows = se.search(ix.build_index(docs, "TF_LDP", b=0.8, d=0.4), ask(spark, "rare"), 30, padded=True).orderBy("rank").collect()
    assert rows[-1]["doc_id"] == 0 and rows[-1]["score"] < 0 and rows[0]["score"] == 0


def test_dlite_of_a_term_in_every_document(spark):
    docs = analyze(spark.createDataFrame([("xx", i, "same") for i in range(3)], "lang string, doc_id long, text string"))
    assert all(r["weight"] == pytest.approx(0, abs=1e-12) for r in ix.build_index(docs, "DLITE").postings.collect())


def plain_weight(method, c, length, mean, total, n, k1, b, d):
    """The formulae once more, in plain Python."""
    k = k1 * (1 - b * (1 - length / mean))
    q = n / total
    dlite = (1 - q) / 2 + (1 - q * (1 - math.log(q))) - (1 - q * q * (1 - 2 * math.log(q))) / (2 + 2 * q)
    tf = {"ratio": lambda: c / length, "saturating": lambda: c / (c + k), "plus": lambda: d + (1 + k1) * c / (c + k), "ldp": lambda: 1 + math.log(1 + math.log(d + c / (1 - b + b * length / mean)))}
    idf = {"smooth": math.log((1 + total) / (1 + n)) + 1, "okapi": math.log((total - n + 0.5) / (n + 0.5) + 1), "logn1": math.log((total + 1) / n), "dlite": dlite, "dlite_cbrt": math.copysign(abs(dlite) ** (1 / 3), dlite)}
    t, i, _ = weighting.METHODS[method]
    return tf[t]() * idf[i]


@pytest.mark.parametrize("method", GOLDEN)
def test_against_plain_python(spark, sf, method):
    rows = ix.weigh(ix.statistics(catalogue.docs(spark, sf)), method, 1.3, 0.6, 0.9).where("doc_id % 40 = 0").collect()
    assert rows
    for r in rows:
        assert r["weight"] == pytest.approx(plain_weight(method, r["c"], r["dl"], r["avg_len"], r["n_docs"], r["n"], 1.3, 0.6, 0.9), rel=1e-9, abs=1e-12)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 999))
def test_dlite_falls_with_document_frequency(n):
    f = lambda n: plain_weight("DLITE", 1, 1, 1, 1000, n, 0, 0, 1)
    assert f(n) >= f(n + 1) - 1e-12 >= -1e-12


def test_validation():
    for bad in ({"method": "X"}, {"k1": -1.0}, {"b": 2.0}, {"d": -0.1}):
        with pytest.raises(ValueError):
            weighting.check(**({"method": "TFIDF", "k1": 1.5, "b": 0.75, "d": 1.0} | bad))


def test_best_method_by_language(spark):
    rows = [(g, i, t) for g in ("de", "en") for i, t in enumerate(["haus und hof", "hof", "baum"])]
    docs = analyze(spark.createDataFrame(rows, "lang string, doc_id long, text string"))
    index = ix.build_index(docs, params=evaluate.best_params(spark))
    assert {(r["lang"], r["method"]) for r in index.meta.collect()} == {("de", "BM25_V1"), ("en", "TF_LDP")}


def test_grid_ignores_inert_parameters(spark, toy):
    truth = spark.createDataFrame([(0, "xx", 0)], "query_id long, lang string, doc_id long")
    got = evaluate.grid_search(toy, ask(spark, "apple"), truth, "TFIDF", [(1.0, 0.5, 1.0), (2.0, 0.9, 0.5)]).collect()
    assert sorted((r["k1"], r["recall"]) for r in got) == [(1.0, 1.0), (2.0, 1.0)]
    assert len(set(evaluate.grid_values())) == 286


def test_submission_text(spark):
    rows = spark.createDataFrame([(7, "en", 2, 5, 0.5), (7, "en", 1, 9, 0.7)], "query_id long, lang string, rank long, doc_id long, score double")
    assert evaluate.submission(rows).first() == (7, "['9', '5']")


def test_save_and_load(spark, toy, tmp_path):
    index = ix.build_index(toy, "BM25_PLUS")
    ix.save_index(index, str(tmp_path / "i"))
    loaded = ix.load_index(spark, str(tmp_path / "i"))
    rows = lambda i: sorted(map(tuple, se.search(i, ask(spark, "banana cherry"), padded=True).collect()))
    assert rows(index) == rows(loaded)
    other = ix.build_index(toy, "TFIDF")
    ix.save_index(other, str(tmp_path / "i"))
    assert rows(ix.load_index(spark, str(tmp_path / "i"), "TFIDF", ["xx"])) == rows(other)
    assert rows(ix.load_index(spark, str(tmp_path / "i"), {"xx": "BM25_PLUS"})) == rows(index)
    with pytest.raises(ValueError):
        ix.load_index(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        ix.load_index(spark, str(tmp_path / "i"), "DLITE")


def test_padding_reads_a_bounded_number_of_documents(spark):
    docs = analyze(spark.createDataFrame([("xx", i, "same" if i % 7 else "rare same") for i in range(300)], "lang string, doc_id long, text string"))
    rows = se.search(ix.build_index(docs), ask(spark, "rare", "zzzz"), 50, padded=True).collect()
    assert sorted(r["doc_id"] for r in rows if r["query_id"] == 1) == list(range(50))
    assert [r["doc_id"] for r in rows if r["query_id"] == 0 and r["score"] == 0] == [i for i in range(300) if i % 7][: 50 - 43]


def test_an_added_method_is_found_by_name(spark, toy, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setitem(weighting.TF, "raw", lambda c, length, mean, k1, b, d: c)
    monkeypatch.setitem(weighting.IDF, "one", lambda total, n: F.lit(1.0))
    monkeypatch.setitem(weighting.METHODS, "COUNT", ("raw", "one", ()))
    got = {(r["doc_id"], r["term"]): r["weight"] for r in ix.build_index(toy, "COUNT").postings.collect()}
    assert got == {(0, "apple"): 2.0, (0, "banana"): 1.0, (1, "banana"): 1.0, (1, "cherry"): 1.0}
    params = spark.createDataFrame([("xx", "COUNT", 1.5, 0.75, 1.0)], "lang string, method string, k1 double, b double, d double")
    assert {r["weight"] for r in ix.build_index(toy, params=params).postings.collect()} == {1.0, 2.0}


def test_stream_of_queries(spark, toy, tmp_path):
    from lexgrid.streaming.scoring import answer_stream

    spark.createDataFrame([(1, "apple", "xx"), (2, "cherry", "xx")], "query_id long, text string, lang string").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("query_id long, text string, lang string").parquet(str(tmp_path / "q"))
    run = answer_stream(stream, ix.build_index(toy), str(tmp_path / "out"), str(tmp_path / "cp"))
    run.processAllAvailable()
    run.stop()
    assert {(r["query_id"], r["doc_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0), (2, 1)}


def test_readers_and_command_line(spark, tmp_path):
    from lexgrid import cli

    (tmp_path / "corpus.json").write_text('[{"docid": "a", "text": "the red house", "lang": "en"}, {"docid": "b", "text": "a blue\\ncar", "lang": "en", "more": 1}, {"docid": "c", "text": "x", "lang": "zz"}]')
    (tmp_path / "dev.csv").write_text('query,positive_docs,lang\n"red, ""house""",a,en\n"blue\ncar",a,en\n')
    assert readers.read_corpus_json(spark, str(tmp_path / "corpus.json")).count() == 3
    assert [r["query"] for r in readers.read_queries_csv(spark, str(tmp_path / "dev.csv")).collect()] == ['red, "house"', "blue\ncar"]
    got = cli.main(["search", "--corpus", str(tmp_path / "corpus.json"), "--queries", str(tmp_path / "dev.csv"), "--top", "1", "--save", str(tmp_path / "index"), "--out", str(tmp_path / "runs")])
    assert {(r["lang"], r["recall"]) for r in got.collect()} == {("en", 0.5), ("*", 0.5)}
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert runs.count() == 2 and {(r["method"], r["b"]) for r in runs.collect()} == {("TFIDF", 0.75)}
    assert all(r[x] > 0 for r in runs.collect() for x in ("build_seconds", "save_seconds", "search_seconds"))
    assert {r["term"] for r in spark.read.parquet(str(tmp_path / "index" / "vocabulary")).collect()} == {"red", "hous", "blue", "car"}
    (tmp_path / "test.csv").write_text('query,lang\n"house",en\n"car",en\n"car",en\n')
    out = cli.main(["submit", "--corpus", str(tmp_path / "corpus.json"), "--queries", str(tmp_path / "test.csv"), "--out", str(tmp_path / "sub")])
    assert sorted(map(tuple, out.collect())) == [(0, "['a']"), (1, "['b']"), (2, "['b']")]
    written = [f.read_text() for f in (tmp_path / "sub").glob("*.csv")]
    assert written == ["id,docids\n0,['a']\n1,['b']\n2,['b']\n"]


def test_grid_on_the_command_line_with_tables(spark, tmp_path, monkeypatch):
    from lexgrid import cli

    (tmp_path / "corpus.json").write_text('[{"docid": "a", "text": "kitab xyx", "lang": "ar"}, {"docid": "b", "text": "kutub", "lang": "ar"}]')
    (tmp_path / "dev.csv").write_text("query,positive_docs,lang\nkutub,a,ar\nkutub,b,ar\n")
    (tmp_path / "words.csv").write_text("lang,word\nar,xyx\n")
    (tmp_path / "stems.csv").write_text("lang,word,base\nar,kutub,ktb\nar,kitab,ktb\n")
    monkeypatch.setattr(evaluate, "grid_values", lambda: [(1.5, 0.75, 1.0), (1.0, 0.5, 1.0)])
    got = cli.main(["grid", "--corpus", str(tmp_path / "corpus.json"), "--queries", str(tmp_path / "dev.csv"), "--method", "BM25_V1", "--stems", str(tmp_path / "stems.csv"), "--stopword-table", str(tmp_path / "words.csv")])
    assert {(r["k1"], r["b"], r["lang"], r["recall"]) for r in got.collect()} == {(1.5, 0.75, "ar", 1.0), (1.0, 0.5, "ar", 1.0)}
    assert "(default: TFIDF)" in cli.parser().format_help() and "default: None" not in cli.parser().format_help()


def test_vocabulary_of_string_ids(spark):
    docs = analyze(spark.createDataFrame([("xx", "b", "dd cc dd"), ("xx", "a", "cc aa"), ("yy", "c", "zz"), ("yy", "a", "")], "lang string, doc_id string, text string"))
    assert sorted(map(tuple, stats.vocabulary(docs).collect())) == [("xx", "aa", 1), ("xx", "cc", 0), ("xx", "dd", 2), ("yy", "zz", 0)]


QUERIES = ["tokenize", "stopword_filter", "stopword_filter_default", "query_terms_filtered", "vocab_string_ids", "grid_search_full", "corpus_stats", "vocab_first_appearance", "query_terms_in_vocab", "idf_dlite_cbrt", "tf_ldp", "index_tf_ldp", "search_bm25_v1", "search_padded", "search_ldp_negative", "search_best_by_lang", "recall_overall", "grid_search_bm25", "submission", "index_round_trip"]
QUERIES += ["topk_bm25_v1", "topk_ldp_negative", "topk_best_by_lang", "index_blocked", "index_interrupted", "corpus_json", "queries_csv", "tf_based", "tf_based_tokens"]


@pytest.mark.parametrize("name", QUERIES)
def test_catalogue_against_sql(spark, sf, name):
    same_rows(catalogue.queries()[name](spark, sf), catalogue.oracle_sql()[name], sf)


def test_every_query_is_registered(spark):
    assert set(catalogue.oracle_sql()) == set(catalogue.queries()) - {"stem_snowball"}
    assert set(catalogue.queries()) <= set(entry_module.queries())
    assert entry_module.entry(spark).columns == ["item_id", "lang", "rank", "doc_id", "score"]


def test_plan_of_a_search(spark, sf):
    """The regular expression is evaluated once, only three columns are read, and the top k is limited before the shuffle."""
    plan = catalogue.queries()["search_bm25_v1"](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "n_chars" not in plan.split("== Physical Plan ==")[1]
